"""Queries for ingest, gates and small stage parts. Services are stood in for by transports over the driver's tables."""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import product
from urllib.error import HTTPError
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import functions as F

from gridloom.errors import GateError
from gridloom.functions import claims, scalar as S
from gridloom.operators import facilities, flow, vector, zonal
from gridloom.plans import figures, grid as G, laws, substrate as B
from gridloom.plans.queries import CELLS, INSIDE_SQL, query, table
from gridloom.sources import geojson, ingest

# ---- services ----


def service(features: list[dict], where=lambda p, w: True):
    """A transport that answers like a layer of points: spatial reference, filter, envelope, pages. It fails once before each address works."""
    failed = set()

    @lru_cache(1)
    def found(asked_where: str, area: str | None) -> list[dict]:
        of = [x for x in features if where(x["properties"], asked_where)]
        if area is None:
            return of
        w, s, e, n = map(float, area.split(","))
        return [x for x in of if w <= x["geometry"]["coordinates"][0][0] <= e and s <= x["geometry"]["coordinates"][0][1] <= n]

    def send(url: str, form: dict[str, str] | None) -> bytes:
        parts = urlsplit(url)
        if parts.path not in failed:
            failed.add(parts.path)
            raise HTTPError(url, 503, "busy", None, None)
        asked = form if form is not None else {k: v[0] for k, v in parse_qs(parts.query).items()}
        if asked.get("f") == "pjson":
            return json.dumps({"extent": {"spatialReference": {"wkid": 1, "latestWkid": 4269}}}).encode()
        of = found(asked["where"], asked["geometry"] if asked.get("geometryType") == "esriGeometryEnvelope" else None)
        at, most = int(asked.get("resultOffset", 0)), int(asked.get("resultRecordCount", len(of) or 1))
        return json.dumps({"features": of[at : at + most], "properties": {"exceededTransferLimit": at + most < len(of)}}).encode()

    return send


def client(send) -> ingest.Client:
    return ingest.Client(send, wait=lambda s: None)


def at_suppliers(spark, d, props) -> list[dict]:
    """Suppliers as short lines from points of a 1/32 degree grid; the service that they stand for holds few rows."""
    rows = table(spark, d, "supplier").orderBy("s_suppkey").collect()
    place = lambda k: (-87.5 + k % 32 / 32, 41.5 + k % 12 / 32)
    return [{"properties": props(r), "geometry": {"type": "LineString", "coordinates": [place(r.s_suppkey), (-80.0, 45.0)]}} for r in rows]


def flood(spark, d):
    return service(at_suppliers(spark, d, lambda r: {"OBJECTID": None if r.s_suppkey % 10 == 0 else r.s_suppkey, "FLD_ZONE": "AE" if r.s_nationkey % 2 else "X"}))


def by_zone(spark, features):
    t = ingest.features_table(spark, features)
    return t.select(geojson.first_of(F.col("props"), ("objectid", "OBJECTID")).cast("long").alias("objectid"), geojson.first_of(F.col("props"), ("fld_zone", "FLD_ZONE")).alias("zone")).groupBy("objectid", "zone").agg(F.count("*").alias("n"))


ZONE_SQL = "case when s_suppkey % 10 <> 0 then s_suppkey end as objectid, case when s_nationkey % 2 = 1 then 'AE' else 'X' end as zone"


@query(f"select objectid, zone, cast(sum(case when objectid is null then tiles else 1 end) as bigint) as n from (select {ZONE_SQL}, (case when s_suppkey % 32 in (8, 16, 24) then 2 else 1 end) * (case when s_suppkey % 12 = 8 then 2 else 1 end) as tiles from supplier) group by 1, 2")
def flood_zone_tiles(spark, d):
    """Flood zones tile by tile: those on a border come with both tiles, and once each if they have an id."""
    return by_zone(spark, ingest.flood_zones(client(flood(spark, d)), (-87.5, 41.5, -86.5, 41.875), ingest.Layer(ingest.FLOOD_ZONES, ingest.ALL, ingest.FLOOD_FIELDS, 7, more={"orderByFields": "OBJECTID"})))


@query(f"select objectid, zone, count(*) as n from (select {ZONE_SQL} from supplier) group by 1, 2")
def flood_zone_layer(spark, d):
    return by_zone(spark, ingest.flood_zones(client(flood(spark, d)), None, ingest.Layer(ingest.FLOOD_ZONES, ingest.ALL, ingest.FLOOD_FIELDS, 11, ingest.LAYER_PAGES)))


@query("select case when s_nationkey % 3 = 0 then '460' when s_nationkey % 3 = 1 then '558' else '' end as ftype, count(*) as n from supplier group by 1")
def water_types(spark, d):
    """The histogram of types of the features of a water layer."""
    props = lambda r: {"objectid": r.s_suppkey, **([{"ftype": 460}, {"FTYPE": "558"}, {"fcode": 46006}][r.s_nationkey % 3])}
    layer = ingest.Layer(ingest.FLOWLINES, ingest.STREAMS, ingest.WATER_FIELDS, 13, ingest.TILE_PAGES)
    found = ingest.water(client(service(at_suppliers(spark, d, props))), layer, [[(-88.0, 41.0), (-86.0, 41.0), (-86.0, 42.0), (-88.0, 42.0), (-88.0, 41.0)]])
    return zonal.type_counts(ingest.features_table(spark, found))


@query("select '040400010' || n_nationkey % 3 as huc10, n_name as name from nation where n_nationkey % 4 <> 0")
def unit_blocks(spark, d):
    rows = table(spark, d, "nation").collect()
    features = [{"properties": {"huc10": f"{'09090909' if r.n_nationkey % 4 == 0 else '04040001'}0{r.n_nationkey % 3}", "name": r.n_name}, "geometry": {"type": "LineString", "coordinates": [[0.0, 0.0], [1.0, 1.0]]}} for r in rows]
    like = lambda p, w: p["huc10"].startswith(w.split("'")[1].rstrip("%"))
    t = ingest.features_table(spark, ingest.blocks(client(service(features, like)), "04040001"))
    return t.select(geojson.first_of(F.col("props"), ("huc10",)).alias("huc10"), geojson.first_of(F.col("props"), ("name",)).alias("name"))


@query("select '04040001' as code, n_name as name, 'IN' as states, 4269 as crs from nation where n_nationkey = 3")
def unit_document(spark, d):
    rows = table(spark, d, "nation").where("n_nationkey in (3, 5)").collect()
    box = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    features = [{"properties": {"huc8": "04040001" if r.n_nationkey == 3 else "05120201", "name": r.n_name, "states": "IN"}, "geometry": {"type": "Polygon", "coordinates": box}} for r in rows]
    doc = ingest.unit(client(service(features, lambda p, w: p["huc8"] == w.split("'")[1])), "04040001")
    t = ingest.features_table(spark, doc["features"])
    crs = geojson.crs_code(doc["crs"]["properties"]["name"])
    return t.select(geojson.first_of(F.col("props"), geojson.CODE).alias("code"), *[geojson.first_of(F.col("props"), (n,)).alias(n) for n in ("name", "states")], F.lit(crs).alias("crs"))


@query("select 'F' || s_suppkey as key, s_name as name, cast(s_nationkey as double) as on_site_release_lb, 2022 as year from supplier where s_suppkey % 4 <> 3 and s_suppkey % 5 <> 0")
def release_years(spark, d):
    """Releases page by page and state by state, of the first year that has any inside."""
    rows, states = table(spark, d, "supplier").orderBy("s_suppkey").collect(), ("IN", "IL", "MI", "OH")

    @lru_cache(1)
    def of_state(year: str, state: str) -> list[dict]:
        return [{"ST": state, "LATITUDE": "41.5" if year == "2022" and r.s_suppkey % 5 else "3.0", "LONGITUDE": "-87.0", "FRS ID": f"F{r.s_suppkey}", "FACILITY NAME": r.s_name, "ON-SITE RELEASE TOTAL": str(r.s_nationkey)} for r in rows if states[r.s_suppkey % 4] == state]

    def send(url: str, form):
        *_, year, _, state, _, span, _ = urlsplit(url).path.split("/")
        a, b = map(int, span.split(":"))
        return json.dumps(of_state(year, state)[a - 1 : b]).encode()

    def inside(year: int):
        raw = ingest.rows_table(spark, ingest.releases(client(send), year, facilities.STATES, page=9))
        return facilities.rollup(facilities.parse_releases(raw, F.col("ordinal")), year).where("lat between 41 and 42")

    return facilities.first_year(inside)[1].select("key", "name", "on_site_release_lb", "year")


@query("select r as \"row\", c as col, 100 + r * 3 + c / 4.0::double as z from range(70) a(r), range(50) b(c) where (r + c) % 5 <> 0 and (r + c) % 7 <> 0")
def elevation_tiles(spark, d):
    grid = G.GridSpec.at(750000.0, 2170000.0, 50, 70, kind=G.LIVE_KIND)

    def send(url: str, form):
        w, _, _, n = map(float, parse_qs(urlsplit(url).query)["bbox"][0].split(","))
        width, height = map(int, parse_qs(urlsplit(url).query)["size"][0].split(","))
        r0, c0 = round((2170000.0 - n) / 30), round((w - 750000.0) / 30)
        return b"II*\x00" + json.dumps([[-9999.0 if (r + c) % 7 == 0 else 100 + r * 3 + c / 4 for c in range(c0, c0 + width)] for r in range(r0, r0 + height)]).encode()

    inside = grid.cells(spark).where((F.col("row") + F.col("col")) % 5 != 0)
    cells = ingest.elevation(spark, client(send), grid, inside, lambda raw: json.loads(raw[4:]), 20)
    return cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "z")


# ---- grids and rasters ----


@query(f"with {CELLS} select min(zp) as dem_min, max(zp) as dem_max, count(*) as n from cells where valid")
def dem_range(spark, d):
    z = F.when(F.col("valid"), F.col("zp"))
    return B.cells(spark, d).agg(F.min(z).alias("dem_min"), F.max(z).alias("dem_max"), F.count(z).alias("n"))


@query(f"with {INSIDE_SQL} select r as \"row\", c as col, max(feature) + 1 as block_id from inside group by r, c")
def block_raster(spark, d):
    numbered = B.shapes(spark).withColumn("block_id", F.col("feature") + 1)
    return vector.rasterize(numbered, "block_id", "block_id", *B.SHAPE_GRID).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "block_id")


EDGE_T = "case when {d} = 0 then case when floor({a}) = {k} then 0.0 else 2.0 end else least(({k} - {a}) / {d}, ({k} + 1 - {a}) / {d}) end as {n}0, case when {d} = 0 then 1.0 else greatest(({k} - {a}) / {d}, ({k} + 1 - {a}) / {d}) end as {n}1"


@query(f"""with {B.shape_edges_sql()}, t as (select r, c, {EDGE_T.format(d='(x2 - x1)', a='x1', k='c', n='u')}, {EDGE_T.format(d='(y1 - y2)', a='(-y1)', k='r', n='v')} from range(40) a(r), range(40) b(c), edges)
 select distinct r as "row", c as col from t where greatest(u0, v0, 0) + 1e-12 < least(u1, v1, 1)""")
def touched_mask(spark, d):
    """Every cell that a line passes, as intervals of the line within each cell would have it."""
    cells = vector.touched_cells(vector.edges_of(B.shapes(spark)), *B.SHAPE_GRID)
    return cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


@query("select range as cell_id, cast(range // 32 as int) as \"row\", cast(range % 32 as int) as col, 0 as band from range(1024)")
def fixture_grid(spark, d):
    return G.GridSpec.fixture().cells(spark).withColumn("band", F.lit(0))


@query(f"with {INSIDE_SQL} select r as \"row\", c as col, case when exists (select 1 from inside i where i.r = g.r and i.c = g.c) then (r + c) % 101 else 255 end as band from g")
def synthetic_unit(spark, d):
    """The made-up band of a unit: 255 beyond its polygons."""
    inside = vector.cells_of(vector.spans(vector.edges_of(B.shapes(spark)), *B.SHAPE_GRID))
    band = G.GridSpec(40, 40, B.SHAPE_GRID[2]).synthetic_band(spark, inside)
    return band.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("band").cast("long").alias("band"))


@query(f"with {INSIDE_SQL} select count(*) as n from (select r, c from inside group by r, c)")
def geometry_union(spark, d):
    """Cells of the union of a unit's polygons."""
    return vector.cells_of(vector.spans(vector.edges_of(B.shapes(spark)), *B.SHAPE_GRID)).select("row", "col").distinct().agg(F.count("*").alias("n"))


@query(f"with {CELLS} select list_aggregate(list_sort(list(distinct block_id)), 'string_agg', ',') as blocks, list_aggregate(list_sort(list(distinct zone)), 'string_agg', ',') as zones from cells where valid")
def present_codes(spark, d):
    seen = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(F.col("valid"), F.col(c)))).cast("array<string>"), ",").alias
    return B.cells(spark, d).agg(seen("block_id")("blocks"), seen("zone")("zones"))


# ---- gates: what each lets pass ----


def outcome(f, *args) -> bool:
    """Whether a gate lets pass."""
    try:
        f(*args)
        return True
    except GateError:
        return False




@query("""with s as (select range::int as rank, ['0','A','B','C','D'][range + 1] as stage from range(5)), b as (select unnest([true, false]) as v)
 select c.stage as current, t.stage as target, live.v as live, u.v as unshaded_ok, a.v as report_a, bb.v as report_b, k.v as calibrated, p.v as samples_p,
  array_to_string(list_filter([case when t.rank > c.rank + 1 then 'stage_skip' end, case when t.rank >= 1 and not live.v then 'advance_on_fixture_template' end, case when t.rank >= 2 and not u.v then 'advance_without_firm_unshaded_x' end,
   case when t.rank >= 2 and not a.v then 'advance_without_stage_a' end, case when t.rank >= 3 and not a.v then 'stage_c_without_a' end, case when t.rank >= 3 and not bb.v then 'stage_c_without_b' end,
   case when (t.rank >= 4 or p.v) and not k.v then 'sample_p_before_isotonic' end], lambda x: x is not null), ',') as violations
 from s c, s t, b live, b u, b a, b bb, b k, b p""")
def stage_gates(spark, d):
    """Every step between stages under all facts, and what forbids it."""
    rows = []
    for now, to, live, *facts in product(laws.ORDER, laws.ORDER, *[(True, False)] * 6):
        rows.append((now, to, live, *facts, ",".join(laws.stage_gate(now, to, laws.Facts(G.LIVE_KIND if live else "fixture", *facts)))))
    return spark.createDataFrame(rows, "current string, target string, live boolean, unshaded_ok boolean, report_a boolean, report_b boolean, calibrated boolean, samples_p boolean, violations string")


@query("""select n_nationkey as key, code is not null and code = '04040001' and (states = '' or contains(upper(states), 'IN')) and (area is null or area between 1200 and 2500) as pass,
  case when code = '05120201' then 'parent_unit' when code <> '04040001' then 'other_unit' else '' end as lock
 from (select n_nationkey, case n_nationkey % 5 when 0 then null when 1 then '05120201' when 2 then '04040002' else '04040001' end as code, case n_regionkey when 0 then '' when 1 then 'oh' else 'il,in' end as states,
  case when n_nationkey % 3 = 0 then null else 600.0 + n_nationkey * 100 end as area from nation)""")
def unit_gates(spark, d):
    rows = []
    for r in table(spark, d, "nation").collect():
        k = r.n_nationkey
        code = {0: None, 1: laws.REFUSED_UNIT, 2: "04040002"}.get(k % 5, laws.UNIT)
        states, area = {0: "", 1: "oh"}.get(r.n_regionkey, "il,in"), None if k % 3 == 0 else 600.0 + k * 100
        rows.append((k, outcome(laws.require_unit, code, states, area), ",".join(laws.unit_lock(code)) if code else None))
    return spark.createDataFrame(rows, "key int, pass boolean, lock string").withColumn("lock", F.when(F.col("lock").isNull(), F.lit("")).otherwise(F.col("lock")))


@query("""select n_nationkey as key, stage = 'A' and gate = 'pass' and unit = '04040001' and print_ = 'f1' as pass from (select n_nationkey, case when n_nationkey % 4 = 0 then 'B' else 'A' end as stage, case when n_nationkey % 3 = 0 then 'fail' else 'pass' end as gate,
  case when n_nationkey % 7 = 0 then '05120201' else '04040001' end as unit, case when n_nationkey % 5 = 0 then 'f2' else 'f1' end as print_ from nation)""")
def upstream_gates(spark, d):
    rows = []
    for r in table(spark, d, "nation").collect():
        k = r.n_nationkey
        report = {"stage": "A" if k % 4 else "B", "gate": "pass" if k % 3 else "fail", "huc8": laws.UNIT if k % 7 else laws.REFUSED_UNIT, "grid_sha256": "f1" if k % 5 else "f2"}
        rows.append((k, outcome(laws.require_report, report, "A", laws.UNIT, "f1")))
    return spark.createDataFrame(rows, "key int, pass boolean")


@query(f"""with {CELLS}, n as (select zone, count(*) as c from cells where valid group by zone), top as (select arg_max(zone, (c, -zone)) as zone from n)
 select (select zone = 4 from top) as unshaded_majority, (select count(*) = 0 from cells where zone = 2 and zone not in (1, 2)) as floodway_in_hazard, (select count(*) > 0 from cells where valid and zone in (1, 2)) and (select count(*) > 0 from cells where valid and zone not in (1, 2)) as both_classes,
  (select count(*) = 0 from cells where valid and zp is null) as finite, (select count(*) > 0 from cells where valid and zp <> zt) as different, false as same, (select count(*) = 0 from cells where not valid and stream) as undefined_empty""")
def band_gates(spark, d):
    """Which of the gates on bands the cells pass."""
    c = B.cells(spark, d).withColumn("sfha", S.sfha_band(F.col("zone")))
    v = c.where("valid")
    band = lambda x: v.select("row", "col", F.col(x).alias("v"))
    got = {
        "unshaded_majority": outcome(zonal.require_unshaded_majority, v, True),
        "floodway_in_hazard": outcome(zonal.require_floodway_in_sfha, c),
        "both_classes": outcome(zonal.require_both_classes, v),
        "finite": outcome(flow.require_finite, c, "zp"),
        "different": outcome(zonal.require_different, band("zp"), band("zt"), "bands"),
        "same": outcome(zonal.require_different, band("zp"), band("zp"), "bands"),
        "undefined_empty": outcome(zonal.require_undefined_empty, c.withColumn("hand", F.when(F.col("valid"), F.col("zp"))), c.withColumn("p", F.when(F.col("stream"), F.col("p"))), ("p",)),
    }
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} boolean" for k in got))


@query("""select n_nationkey as key, mix <> 'x' and place <> 'parent' and name <> 'Monument Circle' as pass from (select n_nationkey, case when n_nationkey % 3 = 0 then 'x' else 'both' end as mix, case when n_nationkey % 4 = 0 then 'parent' else 'here' end as place, case when n_nationkey % 5 = 0 then 'Monument Circle' else n_name end as name from nation)""")
def sample_gates(spark, d):
    rows = []
    for r in table(spark, d, "nation").collect():
        k = r.n_nationkey
        lon, lat = laws.REFUSED_POINT if k % 4 == 0 else (-87.3, 41.5)
        samples = [("Monument Circle" if k % 5 == 0 else r.n_name, lon + 0.01, lat - 0.02, "unshaded_x"), ("b", -87.3, 41.6, "unshaded_x" if k % 3 == 0 else "floodway")]
        rows.append((k, outcome(laws.require_samples, samples)))
    return spark.createDataFrame(rows, "key int, pass boolean")


@query("select c_custkey as key, c_custkey % 3 = 0 as pass, c_custkey % 2 = 0 as area_pass from customer where c_custkey < 60")
def request_gates(spark, d):
    """Requests for flood zones that ask for all, and areas near the pin."""
    where = ["1=1", "FLD_ZONE = 'X'", "1=1 and SFHA_TF='T'"]
    rows = []
    for r in table(spark, d, "customer").where("c_custkey < 60").select("c_custkey").collect():
        k = r.c_custkey
        url = ingest.Layer(ingest.FLOOD_ZONES, where[k % 3], ingest.FLOOD_FIELDS, 5).get_url(k)
        rows.append((k, outcome(ingest.require_unfiltered, url), outcome(laws.require_area_pin, laws.AREA_PIN + (1.9 if k % 2 == 0 else -2.1))))
    return spark.createDataFrame(rows, "key long, pass boolean, area_pass boolean")


@query("""select n_nationkey as key, p and s and not e and not h and c as pass from (select n_nationkey, n_nationkey % 7 <> 0 as p, n_nationkey % 5 <> 0 as s, n_nationkey % 11 = 0 as e, n_nationkey % 3 = 0 as h, n_nationkey % 4 <> 0 as c from nation)""")
def overlay_report_gates(spark, d):
    rows = []
    for r in table(spark, d, "nation").collect():
        k = r.n_nationkey
        row = {"name": "A", "p_max": 0.1, "p_mean": 0.1, "on_site_release_lb": 1.0}
        report = {"p_definition": laws.P_DEFINITION if k % 7 else "other", "p_source": "p_cal (calibrated)" if k % 5 else "raw", "expected_pounds_from_raw_p": k % 11 == 0, "d1_n_unshaded_x": 6, "n_not_d1": 2, "n_tris_huc_year": 8 if k % 4 else 9, "d1_headline_rows": [row] * (4 if k % 3 == 0 else 5)}
        rows.append((k, outcome(laws.require_overlay_report, report)))
    return spark.createDataFrame(rows, "key int, pass boolean")


@query("select contains(string_agg(upper(c_name), ' '), 'CUSTOMER#000000007') as name_refused, false as name_free, true as path_refused, false as path_free from customer")
def name_gates(spark, d):
    c = table(spark, d, "customer")
    got = (not outcome(facilities.refuse_names, c, ("customer#000000007",), "c_name"), not outcome(facilities.refuse_names, c, claims.BANNED_NAMES, "c_name"), not outcome(laws.require_paths, ["/data/Nora/hand.tif"], ("nora",)), not outcome(laws.require_paths, ["/data/unit/hand.tif"], ("nora",)))
    return spark.createDataFrame([got], "name_refused boolean, name_free boolean, path_refused boolean, path_free boolean")


CRS_NAMES = ("EPSG:4269", "urn:ogc:def:crs:EPSG::5070", "4269", "odd", "", "EPSG:x", "WGS84")


@query("select n_nationkey as key, coalesce(try_cast(nullif(regexp_extract(name, '(?:^|:)([0-9]+)\\s*$', 1), '') as int), case when n_regionkey = 1 then 4326 end) as crs from (select *, [" + ", ".join(f"'{x}'" for x in CRS_NAMES) + "][n_nationkey % 7 + 1] as name from nation)")
def crs_sniff(spark, d):
    rows = [(r.n_nationkey, geojson.crs_code(CRS_NAMES[r.n_nationkey % 7], "4326" if r.n_regionkey == 1 else None)) for r in table(spark, d, "nation").collect()]
    return spark.createDataFrame(rows, "key int, crs int")


@query("select s_suppkey as key, case s_suppkey % 4 when 0 then 'a' when 1 then 'B' when 2 then null else 'c' end as code from supplier")
def property_alias(spark, d):
    """The first property of a few names that is set, blanks aside."""
    k = F.col("s_suppkey")
    cases = [{"huc8": " a ", "HUC8": "x"}, {"huc8": "  ", "HUC8": "B"}, {"huc8": "", "other": "y"}, {"HUC": "c"}]
    maps = [F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in cases]
    props = F.when(k % 4 == 0, maps[0]).when(k % 4 == 1, maps[1]).when(k % 4 == 2, maps[2]).otherwise(maps[3])
    return table(spark, d, "supplier").select(k.alias("key"), geojson.first_of(props, geojson.CODE).alias("code"))


# ---- figures ----


@query("select * from (values (0, 'Stage C', '0.274'), (1, 'HAND', '0.220'), (2, 'prevalence', '0.080')) t(ordinal, label, shown)")
def figure_scores(spark, d):
    return figures.scores_figure(spark, 0.274011, 0.219520, 0.079935)[0].select("ordinal", "label", "shown")


@query("select s_suppkey as ordinal, case when s_suppkey = 3 then 'three' else substr(s_name, 1, 22) end as label, (49 - s_suppkey) / 100.0::double as p_max, 0.01::double as p_mean from supplier where s_suppkey < 5")
def figure_screen(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey < 5").select(F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("name"), ((49 - F.col("s_suppkey")) / F.lit(100.0)).alias("p_max"), F.lit(0.01).alias("p_mean"))
    return figures.screen_figure(s, {"000003": "three"})


