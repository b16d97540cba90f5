"""All five stages on a small synthetic unit."""

import json

import pytest
from pyspark.sql import functions as F

from gridloom.errors import GateError
from gridloom.functions import scalar as S
from gridloom.operators import facilities
from gridloom.plans import stages as P
from gridloom.plans.grid import LIVE_KIND, GridSpec
from gridloom.sources import geojson, tables

W, E, N, SO = -87.35, -87.33, 41.57, 41.555


def box(w, s, e, n):
    return [[[w, s], [e, s], [e, n], [w, n], [w, s]]]


def collection(features, crs="EPSG:4269"):
    return json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": crs}}, "features": [{"properties": {k: str(v) for k, v in p.items()}, "geometry": {"type": t, "coordinates": g}} for p, t, g in features]})


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("unit")
    files = {
        "unit": [({"huc8": "04040001", "name": "Small", "states": "IN,IL", "areasqkm": 1903.2}, "Polygon", box(W, SO, E, N))],
        "zones": [({"fld_zone": "X"}, "Polygon", box(W - 1, SO - 1, E + 1, N + 1)), ({"fld_zone": "AE"}, "Polygon", box(W, 41.561, E, 41.563)), ({"FLD_ZONE": "AE", "ZONE_SUBTY": "FLOODWAY"}, "Polygon", box(W, 41.5615, -87.34, 41.562))],
        "lines": [({"ftype": 460}, "LineString", [[W, 41.562], [E, 41.562]]), ({"ftype": 336}, "LineString", [[W, 41.569], [E, 41.569]])],
        "lakes": [({"ftype": 390}, "Polygon", box(-87.342, 41.5565, -87.340, 41.5575))],
        "blocks": [({"huc10": "0404000101"}, "Polygon", box(W, SO, -87.34, N)), ({"huc10": "0404000102"}, "Polygon", box(-87.34, SO, E, N))],
    }
    for name, features in files.items():
        (d / f"{name}.geojson").write_text(collection(features))
    x0, y0 = spark.range(1).select(*S.albers(F.lit(W), F.lit(N))).first()
    grid = GridSpec.at(x0 - 300, y0 + 300, 84, 76, kind=LIVE_KIND)
    return d, grid


def test_stages_run_and_refuse(spark, world, tmp_path):
    d, grid = world
    read = lambda k: geojson.read_features(spark, str(d / f"{k}.geojson"))
    out, unit_path = f"file://{tmp_path}", str(d / "unit.geojson")
    polygons, unit = geojson.load_unit(spark, unit_path)
    assert P.run_stage_0(spark, unit_path, GridSpec.fixture(), out)["gate"] == "pass"
    with pytest.raises(GateError):
        P.run_stage_a(spark, unit_path, GridSpec.fixture(), read("zones"), out)
    a = P.run_stage_a(spark, unit_path, grid, read("zones"), out)
    assert a["zone_counts"]["unshaded_x"] > a["zone_counts"]["sfha"] > a["zone_counts"]["floodway"] > 0
    assert tables.read_report(spark, f"{out}/stage_a_report.json") == a
    z = grid.cells(spark).select("row", "col", (80 - F.col("row") * 0.4 + F.abs(F.col("col") - 40) * 0.05).alias("z"))
    with pytest.raises(GateError):
        P.run_stage_b(spark, grid, unit, z, read("lines"), read("lakes"), read("lakes"), {**a, "gate": "fail"}, f"{out}/zones", out)
    b = P.run_stage_b(spark, grid, unit, z, read("lines"), read("lakes"), read("lakes"), a, f"{out}/zones", out)
    assert b["n_interior"] == sum(a["zone_counts"].values()) and 0 < b["n_stream"] < b["n_interior"] and b["n_hand_undefined"] < b["n_interior"]
    c = P.run_stage_c(spark, grid, unit, read("blocks"), a, b, f"{out}/zones", f"{out}/bands", out, maxIter=3)
    assert c["ap_raw"] > c["prevalence"] and c["probabilities_calibrated"]
    raw = spark.createDataFrame([("IN", str(41.5575 + i * 0.0003), str(-87.348 + i * 0.002), f"Plant {i}", str(i), "LEAD", "POUNDS") for i in range(9)] + [("IN", "42.9", "-87.34", "Far", "1", "LEAD", "POUNDS")], "`5. ST` string, LATITUDE string, LONGITUDE string, `FACILITY NAME` string, `ON-SITE RELEASE TOTAL` string, CHEMICAL string, `UNIT OF MEASURE` string")
    sites = facilities.rollup(facilities.parse_releases(raw), 2023)
    r = P.run_stage_d(spark, grid, unit, polygons, sites, 2023, c, f"{out}/zones", f"{out}/bands", f"{out}/p", out)
    assert r["n_tris_huc_year"] == 9 and len(r["d1_headline_rows"]) == min(5, r["d1_n_unshaded_x"])
    with pytest.raises(GateError):
        P.run_stage_d(spark, grid, unit, polygons, sites, 2023, {**c, "probabilities_calibrated": False}, f"{out}/zones", f"{out}/bands", f"{out}/p", out)
    assert tables.read_cells(spark, f"{out}/zones", (10, 12)).agg(F.max("row")).first()[0] == 12


def test_sources(spark, world, tmp_path):
    d, _ = world
    assert geojson.read_crs(spark, str(d / "unit.geojson")) == 4269
    assert geojson.crs_code("urn:ogc:def:crs:EPSG::5070") == 5070 and geojson.crs_code(None, "4269") == 4269 and geojson.crs_code("odd") is None
    (tmp_path / "none.geojson").write_text(collection([]))
    with pytest.raises(GateError):
        geojson.load_unit(spark, str(tmp_path / "none.geojson"))
    (tmp_path / "codeless.geojson").write_text(collection([({"name": "x"}, "Polygon", box(W, SO, E, N))]))
    with pytest.raises(GateError):
        geojson.load_unit(spark, str(tmp_path / "codeless.geojson"))
    (tmp_path / "r.json").write_text('[{"ST": "IN", "LATITUDE": 1.5}, {"ST": "IL", "LONGITUDE": 2}]')
    assert set(tables.read_releases(spark, str(tmp_path / "r.json"), "json").columns) == {"ST", "LATITUDE", "LONGITUDE", "ordinal"}
