"""Requests, pages, tiles and gates with transports that stand in for services."""

import json
from urllib.error import HTTPError, URLError

import pytest
from pyspark.sql import functions as F

from gridloom.errors import CrsMissingError, EmptyUnitError, FetchError, GateError
from gridloom.functions import claims
from gridloom.plans import figures, grid as G, laws
from gridloom.sources import ingest


def answers(*given, log=None):
    """A transport that gives one answer after another; errors are raised, the rest is JSON."""
    rest = list(given)

    def send(url, form):
        if log is not None:
            log.append((url, form))
        x = rest.pop(0) if len(rest) > 1 else rest[0]
        if isinstance(x, Exception):
            raise x
        return x if isinstance(x, bytes) else json.dumps(x).encode()

    return send


def error(code):
    return HTTPError("u", code, "no", None, None)


def patient(send, **more):
    return ingest.Client(send, wait=lambda s: None, **more)


def test_requests_try_again():
    waits = []
    c = ingest.Client(answers(error(500), URLError("down"), EOFError(), {"a": 1}), wait=waits.append)
    assert c.document("u") == {"a": 1} and waits == [1, 2, 4]
    waits.clear()
    with pytest.raises(FetchError):
        ingest.Client(answers(TimeoutError()), wait=waits.append).bytes("u")
    assert waits == [1, 2, 4, 8, 16]
    log = []
    with pytest.raises(FetchError):
        patient(answers(error(404), log=log)).bytes("u")
    assert len(log) == 1
    for bad in (b"<x>", b"", [1], {"error": {"code": 400}}):
        with pytest.raises(FetchError):
            patient(answers(bad)).document("u", {"a": "b"})


def test_layer_crs():
    assert ingest.layer_crs({"extent": {"spatialReference": {"wkid": 1, "latestWkid": 4269}}}) == 4269
    assert ingest.layer_crs({"sourceSpatialReference": {"wkid": "4269"}}) == 4269
    assert ingest.layer_crs({"spatialReference": {"wkid": "x"}}) is None and ingest.layer_crs({}) is None


def feature(k, **props):
    return {"properties": {"OBJECTID": k, **props}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}


META = {"spatialReference": {"wkid": 4269}}


def test_flood_zones_fall_back_to_get_and_refuse_endless_layers():
    log = []
    page = {"features": [feature(1), feature(None), feature(None)]}
    send = answers(META, error(500), error(500), error(500), page, log=log)
    assert len(ingest.flood_zones(patient(send), (0.0, 0.0, 0.2, 0.2))) == 3
    assert [f is None for _, f in log] == [True, False, False, False, True] and "where=1%3D1" in log[-1][0]
    more = {"features": [feature(1)], "exceededTransferLimit": True}
    with pytest.raises(GateError):
        ingest.flood_zones(patient(answers(META, more)), (0.0, 0.0, 0.2, 0.2))
    with pytest.raises(GateError):
        ingest.flood_zones(patient(answers(META, more)))
    with pytest.raises(GateError):
        ingest.flood_zones(patient(answers(META, {"features": []})))
    with pytest.raises(CrsMissingError):
        ingest.flood_zones(patient(answers({})))
    with pytest.raises(GateError):
        ingest.flood_zones(patient(answers({"spatialReference": {"wkid": 3857}})))
    with pytest.raises(FetchError):
        ingest.flood_zones(patient(answers(META, {"error": "x"})), (0.0, 0.0, 0.2, 0.2))
    with pytest.raises(GateError):
        ingest.flood_zones(patient(answers(META)), None, ingest.Layer(ingest.FLOOD_ZONES, "FLD_ZONE='X'", "a", 5))


def test_units_blocks_water_and_releases():
    ok = {"features": [{"properties": {"HUC8": "04040001"}, "geometry": None}]}
    assert ingest.unit(patient(answers(META, ok)), "04040001")["crs"]["properties"]["name"] == "EPSG:4269"
    for bad in ({"features": []}, {"features": [{"properties": {"huc8": "05120201"}}]}):
        with pytest.raises(EmptyUnitError):
            ingest.unit(patient(answers(META, bad)), "04040001")
    with pytest.raises(GateError):
        ingest.blocks(patient(answers({"features": []})), "04040001")
    assert ingest.water(patient(answers({"features": []})), ingest.AREA_LAYER, [[(0, 0), (1, 0), (1, 1)]]) == []
    with pytest.raises(GateError):
        ingest.water(patient(answers({"features": []})), ingest.WATERBODY_LAYER, [[(0, 0), (1, 0), (1, 1)]])
    with pytest.raises(GateError):
        ingest.water(patient(answers({})), ingest.Layer(ingest.FLOWLINES, "ftype=460", "a"), [])
    with pytest.raises(GateError):
        ingest.releases(patient(answers([])), 2023, ("IN",))
    assert len(ingest.releases(patient(answers([{"a": 1}, {"a": 2}], [{"a": 3}], [])), 2023, ("IN", "IL"), page=2)) == 3
    ring = [(0.0, 0.0), (1.0, 0.001), (2.0, 0.0), (2.0, 2.0), (1.0, 2.5), (0.0, 2.0), (0.0, 0.0)]
    assert ingest.simplified(ring, 0.005) == [p for p in ring if p != (1.0, 0.001)]


def test_tiles(spark):
    grid = G.GridSpec.at(0.0, 3000.0, 40, 34, kind=G.LIVE_KIND)
    made = b"II*\x00"
    sizes = []

    def decode_for(url_sizes):
        return lambda raw: [[1.5] * url_sizes[-1][0] for _ in range(url_sizes[-1][1])]

    def send(url, form):
        sizes.append(tuple(int(x) for x in url.split("size=")[1].split("&")[0].split("%2C")))
        return made

    cells = ingest.elevation(spark, patient(send), grid, grid.cells(spark).where("row < 3"), decode_for(sizes), 30)
    assert cells.count() == 120 and sizes == [(30, 30), (10, 30), (30, 4), (10, 4)]
    for raw in (b"<ServiceException/>", b"PNG"):
        with pytest.raises(FetchError):
            ingest.elevation(spark, patient(lambda u, f, raw=raw: raw), grid, grid.cells(spark), None)
    with pytest.raises(GateError):
        ingest.elevation(spark, patient(lambda u, f: made), grid, grid.cells(spark), lambda raw: [[1.0]])
    with pytest.raises(GateError):
        ingest.elevation(spark, patient(lambda u, f: made), G.GridSpec.fixture(), grid.cells(spark), None)
    assert "LAYERS=NLCD_2021_Impervious_L48" in ingest.land_url(0, 0, 1, 1, 2, 2)


def test_tables_of_features_and_rows(spark):
    t = ingest.features_table(spark, [feature(5, FLD_ZONE="X"), feature(None)])
    assert [(r.ordinal, r.kind, len(r.rings[0])) for r in t.orderBy("ordinal").collect()] == [(0, "LineString", 2), (1, "LineString", 2)]
    assert ingest.rows_table(spark, [{"a": 1}, {"b": None, "c d": 2.5}]).orderBy("ordinal").collect()[1].asDict() == {"ordinal": 1, "a": None, "b": None, "c d": "2.5"}


def test_claims_read_one_table_of_rules(spark, tmp_path):
    texts = ["Nobody was killed", "P is no 100-year exceedance —", "plain", "a Royal Spa Corp site", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.h for r in df.select("i", claims.scan(F.col("t"), claims.BANNED_NAMES).alias("h")).collect()}
    assert got == {i: claims.scan_text(t, claims.BANNED_NAMES) for i, t in enumerate(texts)}
    assert got[0] == ["casualty_count"] and got[1] == ["p_as_100yr", "em_dash"] and got[3] == ["indy_plant_copy"]
    (tmp_path / "a.txt").write_text("fine"), (tmp_path / "b.txt").write_text("unmapped\nrisk and unmapped risk")
    assert [r.hits for r in claims.scan_files(spark, str(tmp_path)).collect()] == [["unmapped_risk"]]


def test_figures_refuse(spark):
    rows, title = figures.scores_figure(spark, 0.3, 0.2, 0.1)
    assert rows.count() == 3 and "0.300" in title
    top = spark.createDataFrame([(i, f"Site {i}-x", 0.4 - i / 100, 0.1) for i in range(5)], "ordinal int, name string, p_max double, p_mean double")
    assert [r.label for r in figures.screen_figure(top, {}).orderBy("ordinal").collect()] == [f"Site {i}" for i in range(5)]
    for bad, more in ((top.limit(4), {}), (top.withColumn("p_max", F.lit(0.5)), {}), (top, {"refused_first": "Site 0"}), (top.withColumn("name", F.lit("FGF LLC")), {})):
        with pytest.raises(GateError):
            figures.screen_figure(bad, {}, **more)


def test_laws_name_all_that_is_broken():
    rows = [{"name": "A", "p_max": 1, "p_mean": 1, "on_site_release_lb": 1}]
    good = {"p_definition": laws.P_DEFINITION, "p_source": "calibrated", "d1_n_unshaded_x": 1, "n_not_d1": 2, "n_tris_huc_year": 3, "d1_headline_rows": rows}
    assert laws.require_overlay_report(good, names=("B",)) is good
    with pytest.raises(GateError, match="counts, headline_fields, headline_names"):
        laws.require_overlay_report(good | {"n_not_d1": "x", "d1_headline_rows": [{"name": "the b plant"}]}, names=("B",))
    with pytest.raises(GateError, match="parent_sample, no_unshaded_x_sample, no_hazard_sample"):
        laws.require_samples([("Monument Circle", 0, 0, "D")])
    assert laws.require_area_pin(1904.0) and laws.stage_gate("A", "C", laws.Facts(G.LIVE_KIND, True, True)) == ["stage_skip", "stage_c_without_b"]
    with pytest.raises(GateError):
        laws.require_area_pin(1900.0)


def test_command_line(spark, tmp_path, capsys):
    from gridloom import cli

    box = [[[-87.4, 41.5], [-87.3, 41.5], [-87.3, 41.6], [-87.4, 41.6], [-87.4, 41.5]]]
    doc = ingest.collection([{"properties": {"huc8": "04040001", "name": "Small", "states": "IN"}, "geometry": {"type": "Polygon", "coordinates": box}}])
    (tmp_path / "unit.geojson").write_text(json.dumps(doc))
    out = f"file://{tmp_path}/out"
    assert cli.main(["0", "--unit", str(tmp_path / "unit.geojson"), "--out", out]) == 0
    assert capsys.readouterr().out.startswith("stage 0 gate=pass unit=04040001 grid=fixture 32x32")
    (tmp_path / "zones.geojson").write_text(json.dumps(doc))
    assert cli.main(["A", "--unit", str(tmp_path / "unit.geojson"), "--out", out, "--zones", str(tmp_path / "zones.geojson")]) == 1


def numbered(n, short=True):
    """A release service of n rows in each state; without an end, its first page comes again and again."""

    def send(url, form):
        a, b = map(int, url.split("/ROWS/")[1].split("/")[0].split(":"))
        return json.dumps([{"k": k} for k in (range(a, min(b, n) + 1) if short else range(1, b - a + 2))]).encode()

    return send


def test_releases_are_read_to_the_last_page():
    for n in (2 * ingest.RELEASE_PAGES, 2 * ingest.RELEASE_PAGES + 1, 5 * ingest.RELEASE_PAGES):
        assert [r["k"] for r in ingest.releases(patient(numbered(n)), 2023, ("IN", "IL"), page=2)] == [*range(1, n + 1)] * 2
    with pytest.raises(GateError, match="repeats itself"):
        ingest.releases(patient(numbered(0, short=False)), 2023, ("IN",), page=2)


def made(n):
    at = lambda k: {"type": "LineString", "coordinates": [[0.1, 0.1], [k, 1.0]]}
    return json.loads(json.dumps([{"properties": {"OBJECTID": k if k % 2 else None, "ftype": 460}, "geometry": at(k)} for k in range(n)]))


RING = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
SAME = {"features": [{"properties": {}}], "properties": {"exceededTransferLimit": True}}


def test_a_layer_is_read_to_its_last_page():
    from gridloom.plans.gate_queries import service

    all_of_it = made(2 * ingest.LAYER_PAGES + 3)
    layer = ingest.Layer(ingest.FLOOD_ZONES, ingest.ALL, ingest.FLOOD_FIELDS, 2, ingest.LAYER_PAGES)
    assert ingest.flood_zones(patient(service(all_of_it)), None, layer) == all_of_it
    with pytest.raises(GateError, match="gave a part"):
        ingest.blocks(patient(answers(SAME)), "04040001")


def test_tiles_of_a_layer_are_read_to_their_last_page():
    from gridloom.plans.gate_queries import service

    all_of_it = made(2 * ingest.TILE_PAGES + 3)
    layer = ingest.Layer(ingest.FLOOD_ZONES, ingest.ALL, ingest.FLOOD_FIELDS, 2)
    assert ingest.flood_zones(patient(service(all_of_it)), (0.0, 0.0, 0.2, 0.2), layer) == all_of_it


def test_water_is_read_to_its_last_page():
    from gridloom.plans.gate_queries import service

    all_of_it = made(2 * ingest.TILE_PAGES + 3)
    layer = ingest.Layer(ingest.FLOWLINES, ingest.STREAMS, ingest.WATER_FIELDS, 2, ingest.TILE_PAGES)
    assert ingest.water(patient(service(all_of_it)), layer, [RING]) == all_of_it
    with pytest.raises(GateError, match="repeats itself"):
        ingest.water(patient(answers(SAME)), ingest.WATERBODY_LAYER, [RING])
