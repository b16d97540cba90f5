"""Driver-side ingest of public map services and release files: requests, retries, pages, tiles.

Everything that talks to a network takes a transport, `send(url, form)` -> bytes (form None: GET), so any source can stand in
for the service. Pages come one after another, as each names where the next begins, however many there are; a service that goes
on and on with what it gave before is refused. What the pages hold becomes a table at once
(`features_table`, `rows_table`), and tables are what the engine works on. Nothing here runs inside a task.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from itertools import count
from urllib.parse import parse_qs, urlencode, urlsplit

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.errors import CrsMissingError, EmptyUnitError, FetchError, GateError
from gridloom.plans.grid import GRID_CRS, RES_M, VECTOR_CRS, GridSpec
from gridloom.plans.laws import require_all_features
from gridloom.session import shared_path
from gridloom.sources.geojson import read_features

Transport = Callable[[str, "dict[str, str] | None"], bytes]

# Addresses of the public services, what is asked of them, and their limits.
UNITS = "https://hydro.nationalmap.gov/arcgis/rest/services/wbd/MapServer/4"
BLOCKS = "https://hydro.nationalmap.gov/arcgis/rest/services/wbd/MapServer/5"
FLOOD_ZONES = "https://hazards.fema.gov/arcgis/rest/services/public/NFHL/MapServer/28"
FLOWLINES, AREAS, WATERBODIES = (f"https://hydro.nationalmap.gov/arcgis/rest/services/nhd/MapServer/{n}" for n in (6, 9, 12))
LAND = "https://www.mrlc.gov/geoserver/mrlc_download/wms"
ELEVATION = "https://elevation.nationalmap.gov/arcgis/rest/services/3DEPElevation/ImageServer/exportImage"
RELEASES = "https://data.epa.gov/efservice/MV_TRI_BASIC_DOWNLOAD"
ALL, STREAMS, RIVERS = "1=1", "ftype IN (460,558)", "ftype=460"
FLOOD_FIELDS, WATER_FIELDS, UNIT_FIELDS, BLOCK_FIELDS = "OBJECTID,FLD_ZONE,ZONE_SUBTY,SFHA_TF,DFIRM_ID", "objectid,ftype,fcode,gnis_name", "huc8,name,states,areasqkm", "huc10,name,areasqkm,states"
FLOOD_PAGE, WATER_PAGE, RELEASE_PAGE = 200, 2000, 10_000
TILE_PAGES, LAYER_PAGES, RELEASE_PAGES = 80, 200, 20
TILE_DEGREES, TILE_CELLS = 0.25, 2000
OFFSET_DEGREES, PRECISION, SIMPLIFY_DEGREES = 0.0001, 6, 0.005
ATTEMPTS, LONGEST_WAIT = 6, 16
TIFF_MAGIC = (b"II*\x00", b"MM\x00*")


def worth_another_try(error: Exception) -> bool:
    """Broken connections are, and answers that blame the server."""
    code = getattr(error, "code", None)
    return code >= 500 if isinstance(code, int) else isinstance(error, (OSError, EOFError))


@dataclass
class Client:
    """A transport with patience: so many attempts, twice as long a wait after each, up to a bound."""

    send: Transport
    attempts: int = ATTEMPTS
    wait: Callable[[float], None] = time.sleep

    def bytes(self, url: str, form: dict[str, str] | None = None) -> bytes:
        for left in reversed(range(self.attempts)):
            try:
                return self.send(url, form)
            except Exception as e:
                if not left or not worth_another_try(e):
                    raise FetchError(f"{'POST' if form else 'GET'} {url}: {e}") from e
                self.wait(min(2 ** (self.attempts - 1 - left), LONGEST_WAIT))
        raise FetchError(f"no attempt was made for {url}")

    def document(self, url: str, form: dict[str, str] | None = None, kind: type = dict):
        raw = self.bytes(url, form)
        try:
            got = json.loads(raw)
        except ValueError as e:
            raise FetchError(f"{url} did not give JSON") from e
        if not isinstance(got, kind):
            raise FetchError(f"{url} gave JSON of another kind")
        if kind is dict and got.get("error"):
            raise FetchError(f"{url} answered with an error: {got['error']}")
        return got


def network(timeout: int = 120, agent: str = "gridloom") -> Transport:
    """The transport of a real network."""

    def send(url: str, form: dict[str, str] | None) -> bytes:
        from urllib.request import Request, urlopen

        data = None if form is None else urlencode(form).encode()
        with urlopen(Request(url, data=data, headers={"User-Agent": agent}), timeout=timeout) as answer:
            return answer.read()

    return send


def layer_crs(meta: dict) -> int | None:
    """The code of a layer's spatial reference; the latest one has precedence."""
    places = (meta.get("extent") or {}).get("spatialReference"), meta.get("sourceSpatialReference"), meta.get("spatialReference")
    reference = next((p for p in places if p), {})
    code = reference.get("latestWkid") or reference.get("wkid")
    return int(code) if str(code or "").strip().lstrip("-").isdigit() else None


@dataclass(frozen=True)
class Layer:
    """What is asked of a layer of features. So many pages in a row may hold nothing new before it is refused."""

    url: str
    where: str
    fields: str
    page: int | None = None
    pages: int = 1
    may_be_empty: bool = False
    more: dict[str, str] = field(default_factory=dict)

    def form(self, offset: int = 0, area: dict[str, str] | None = None) -> dict[str, str]:
        paging = {"resultOffset": str(offset), "resultRecordCount": str(self.page)} if self.page else {}
        return {"where": self.where, "outFields": self.fields, "returnGeometry": "true", "outSR": str(VECTOR_CRS), "f": "geojson", **self.more, **(area or {}), **paging}

    def get_url(self, offset: int = 0, area: dict[str, str] | None = None) -> str:
        return f"{self.url}/query?{urlencode(self.form(offset, area))}"


COARSE = {"maxAllowableOffset": str(OFFSET_DEGREES), "geometryPrecision": str(PRECISION)}
FLOOD_LAYER = Layer(FLOOD_ZONES, ALL, FLOOD_FIELDS, FLOOD_PAGE, LAYER_PAGES, more={**COARSE, "orderByFields": "OBJECTID"})
FLOWLINE_LAYER = Layer(FLOWLINES, STREAMS, WATER_FIELDS, WATER_PAGE, TILE_PAGES)
WATERBODY_LAYER = Layer(WATERBODIES, ALL, WATER_FIELDS, WATER_PAGE, TILE_PAGES)
AREA_LAYER = Layer(AREAS, RIVERS, WATER_FIELDS, WATER_PAGE, TILE_PAGES, may_be_empty=True)


def unit_layer(code: str) -> Layer:
    return Layer(UNITS, f"huc8='{code}'", UNIT_FIELDS, more=COARSE)


def block_layer(code: str) -> Layer:
    return Layer(BLOCKS, f"huc10 LIKE '{code}%'", BLOCK_FIELDS, more=COARSE)


class Progress:
    """Refuses a source when so many pages in a row held nothing but what earlier ones did. There is no bound on pages that bring something."""

    def __init__(self, source: str, patience: int):
        self.source, self.patience, self.idle, self.seen = source, patience, 0, set()

    def take(self, items: list[dict]) -> None:
        had = len(self.seen)
        self.seen.update(blake2b(json.dumps(x, sort_keys=True).encode(), digest_size=16).digest() for x in items)
        self.idle = self.idle + 1 if len(self.seen) == had else 0
        if self.idle >= self.patience:
            raise GateError(f"{self.source} repeats itself: {self.idle} pages in a row without anything new")


def has_more(page: dict) -> bool:
    return any(x.get("exceededTransferLimit") for x in (page, page.get("properties") or {}))


def every_page(layer: Layer, ask: Callable[[int], dict]) -> Iterator[dict]:
    """Features of all pages: ask(offset) gives one. The end is an empty page, or one that does not say there is more."""
    offset, progress = 0, Progress(layer.url, layer.pages)
    while True:
        page = ask(offset)
        batch = page.get("features") or []
        yield from batch
        if not batch or not has_more(page):
            return
        if not layer.page:
            raise GateError(f"{layer.url} gave a part of its features, and no pages were asked for")
        progress.take(batch)
        offset += len(batch)


def envelope(box: tuple[float, float, float, float]) -> dict[str, str]:
    return {"geometry": ",".join(map(str, box)), "geometryType": "esriGeometryEnvelope", "inSR": str(VECTOR_CRS), "spatialRel": "esriSpatialRelIntersects"}


def within(rings: list[list[tuple[float, float]]]) -> dict[str, str]:
    shape = {"rings": [simplified(r, SIMPLIFY_DEGREES) for r in rings], "spatialReference": {"wkid": VECTOR_CRS}}
    return {"geometry": json.dumps(shape), "geometryType": "esriGeometryPolygon", "inSR": str(VECTOR_CRS), "spatialRel": "esriSpatialRelIntersects"}


def simplified(ring: list[tuple[float, float]], near: float) -> list[tuple[float, float]]:
    """A ring without the vertices that lie nearer than that to the line between those kept (Douglas-Peucker); never fewer than a triangle."""
    if len(ring) < 5:
        return list(ring)
    keep, todo = {0, len(ring) // 2, len(ring) - 1}, [(0, len(ring) // 2), (len(ring) // 2, len(ring) - 1)]
    while todo:
        a, b = todo.pop()
        (x1, y1), (x2, y2) = ring[a], ring[b]
        length = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
        far, at = 0.0, None
        for i in range(a + 1, b):
            x, y = ring[i]
            d = abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) / length if length else ((x - x1) ** 2 + (y - y1) ** 2) ** 0.5
            if d > far:
                far, at = d, i
        if at is not None and far > near:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [ring[i] for i in sorted(keep)] if len(keep) > 3 else list(ring)


def boxes(west: float, south: float, east: float, north: float, step: float = TILE_DEGREES) -> list[tuple[float, float, float, float]]:
    """Tiles of an extent, column by column; the last of each is what is left."""

    def cuts(lo: float, hi: float) -> list[float]:
        out = [lo]
        while out[-1] < hi:
            out.append(min(out[-1] + step, hi))
        return out

    xs, ys = cuts(west, east), cuts(south, north)
    found = [(x1, y1, x2, y2) for x1, x2 in zip(xs, xs[1:]) for y1, y2 in zip(ys, ys[1:])]
    if not found:
        raise GateError("the extent has no tiles")
    return found


def attribute(feature: dict, name: str):
    """A property of a feature whatever its case, from `properties` or `attributes`; None if it is missing or empty."""
    props = feature.get("properties") or feature.get("attributes") or {}
    got = props.get(name, next((v for k, v in props.items() if k.lower() == name.lower()), None))
    return None if got == "" else got


def once_each(features: Iterable[dict], key: str = "objectid") -> Iterator[dict]:
    """The first feature of each id. Those without an id all stay."""
    seen = set()
    for f in features:
        k = attribute(f, key)
        if k is None or k not in seen:
            seen.add(k)
            yield f


def some(features: Iterable[dict], layer: Layer) -> list[dict]:
    found = list(features)
    if not found and not layer.may_be_empty:
        raise GateError(f"{layer.url} has no features where {layer.where}")
    return found


def require_unfiltered(url: str) -> str:
    """A request for flood zones must ask for all of them."""
    require_all_features(parse_qs(urlsplit(url).query).get("where", [ALL])[0])
    return url


def flood_zones(client: Client, extent: tuple[float, float, float, float] | None = None, layer: Layer = FLOOD_LAYER, tries: tuple[int, int] = (3, 4)) -> list[dict]:
    """All flood zones of an extent, tile by tile by POST, or by GET where that fails; without an extent the whole layer by GET."""
    require_all_features(layer.where)
    crs = layer_crs(client.document(f"{layer.url}?f=pjson"))
    if crs is None:
        raise CrsMissingError("the layer of flood zones has no spatial reference")
    if crs != VECTOR_CRS:
        raise GateError(f"the layer of flood zones has the reference {crs}")
    if extent is None:
        return some(every_page(layer, lambda at: client.document(require_unfiltered(layer.get_url(at)))), layer)

    def ask(box):
        area = envelope(box)
        patient = [Client(client.send, n, client.wait) for n in tries]

        def page(at: int) -> dict:
            try:
                raw = patient[0].bytes(f"{layer.url}/query", layer.form(at, area))
                return checked(raw, layer.url)
            except FetchError as e:
                if "answered with an error" in str(e):
                    raise
            return patient[1].document(require_unfiltered(layer.get_url(at, area)))

        return page

    tile = Layer(layer.url, layer.where, layer.fields, layer.page, TILE_PAGES, layer.may_be_empty, layer.more)
    return some(once_each(f for box in boxes(*extent) for f in every_page(tile, ask(box))), layer)


def checked(raw: bytes, url: str) -> dict:
    return Client(lambda u, form: raw, 1).document(url)


def water(client: Client, layer: Layer, rings: list[list[tuple[float, float]]]) -> list[dict]:
    """Features of a water layer that meet a polygon."""
    if layer.url == FLOWLINES and not {"460", "558"} <= set("".join(c if c.isdigit() else " " for c in layer.where).split()):
        raise GateError("flowlines must keep the types 460 and 558")
    area = within(rings)
    return some(every_page(layer, lambda at: client.document(f"{layer.url}/query", layer.form(at, area))), layer)


def unit(client: Client, code: str) -> dict:
    """The FeatureCollection of a unit, with its CRS named."""
    layer = unit_layer(code)
    client.document(f"{layer.url}?f=pjson")
    got = client.document(layer.get_url())
    first = next(iter(got.get("features") or []), None)
    if first is None or str(attribute(first, "huc8") or "") != code:
        raise EmptyUnitError(f"the service has no unit {code}")
    return collection(got["features"]) | got


def blocks(client: Client, code: str) -> list[dict]:
    layer = block_layer(code)
    return some(every_page(layer, lambda at: client.document(layer.get_url())), layer)


def collection(features: list[dict], crs: int = VECTOR_CRS) -> dict:
    return {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": f"EPSG:{crs}", "wkid": crs}}, "features": features}


def releases(client: Client, year: int, states: tuple[str, ...], page: int = RELEASE_PAGE) -> list[dict]:
    """Release rows of a year, state by state; a short page is a state's last. RELEASE_PAGES full ones in a row without anything new are refused."""
    rows: list[dict] = []
    for state in states:
        progress = Progress(f"the release service ({state}, {year})", RELEASE_PAGES)
        for k in count():
            part = client.document(f"{RELEASES}/YEAR/{year}/ST/{state}/ROWS/{k * page + 1}:{(k + 1) * page}/JSON", kind=list)
            rows += part
            if len(part) < page:
                break
            progress.take(part)
    if not rows:
        raise GateError(f"no releases in {year}")
    return rows


def land_url(west: float, south: float, east: float, north: float, width: int, height: int, layer: str = "NLCD_2021_Impervious_L48") -> str:
    return f"{LAND}?" + urlencode({"SERVICE": "WMS", "VERSION": "1.3.0", "REQUEST": "GetMap", "LAYERS": layer, "CRS": f"EPSG:{GRID_CRS}", "BBOX": f"{west},{south},{east},{north}", "WIDTH": width, "HEIGHT": height, "FORMAT": "image/geotiff", "STYLES": ""})


def elevation_url(west: float, south: float, east: float, north: float, width: int, height: int) -> str:
    return f"{ELEVATION}?" + urlencode({"bbox": f"{west},{south},{east},{north}", "bboxSR": GRID_CRS, "imageSR": GRID_CRS, "size": f"{width},{height}", "format": "tiff", "pixelType": "F32", "interpolation": "RSP_BilinearInterpolation", "f": "image"})


def require_tiff(raw: bytes, url: str) -> bytes:
    """A picture and not a service's complaint."""
    if raw[:4] in TIFF_MAGIC:
        return raw
    complaint = raw.lstrip()[:1] == b"<" or b"ServiceException" in raw[:400]
    raise FetchError(f"{url} {'answered with an exception: ' + repr(raw[:300]) if complaint else 'did not give a TIFF'}")


def grid_tiles(client: Client, grid: GridSpec, url_of, decode, tile: int = TILE_CELLS) -> Iterator[tuple[int, int, list]]:
    """(first row, first column, rows of values) of the tiles of a grid from the north-west on. decode(bytes) gives rows of numbers."""
    west, south, east, north = grid.bounds()
    for r in range(0, grid.height, tile):
        for c in range(0, grid.width, tile):
            h, w = min(tile, grid.height - r), min(tile, grid.width - c)
            x, y = west + c * RES_M, north - r * RES_M
            url = url_of(x, y - h * RES_M, x + w * RES_M, y, w, h)
            values = decode(require_tiff(client.bytes(url), url))
            if len(values) != h or any(len(v) != w for v in values):
                raise GateError(f"a tile is not {h} x {w}")
            yield r, c, values


def elevation(spark: SparkSession, client: Client, grid: GridSpec, inside: DataFrame, decode, tile: int = TILE_CELLS) -> DataFrame:
    """row, col, z of the cells inside (row, col); a tile's rows go to the workers as they are read and become cells there."""
    grid.require_live()
    rows = [(r + i, c, [float(v) for v in line]) for r, c, values in grid_tiles(client, grid, elevation_url, decode, tile) for i, line in enumerate(values)]
    lines = spark.createDataFrame(rows, "row int, c0 int, line array<double>")
    cells = lines.select("row", "c0", F.posexplode("line").alias("i", "z")).select("row", (F.col("c0") + F.col("i")).alias("col"), "z")
    cells = cells.where(~F.isnan("z") & (F.abs("z") < float("inf")) & (F.col("z") != -9999.0)).join(inside.select("row", "col"), ["row", "col"], "left_semi")
    if cells.isEmpty():
        raise GateError("no cell inside has an elevation")
    return cells


def features_table(spark: SparkSession, features: list[dict], crs: int = VECTOR_CRS) -> DataFrame:
    """ordinal, props, kind, rings: features kept as a GeoJSON file in the shared folder."""
    path = shared_path(spark, "features")
    spark.createDataFrame([(json.dumps(collection(features, crs)),)], "value string").coalesce(1).write.text(path)
    return read_features(spark, path)


def rows_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows of JSON objects as columns of strings, with `ordinal`. Columns are those of any row."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    text = [[i, *(None if r.get(k) is None else str(r[k]) for k in names)] for i, r in enumerate(rows)]
    return spark.createDataFrame(text, ", ".join(["ordinal long", *(f"`{n}` string" for n in names)]))
