"""Operators on small grids whose results are known by hand."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridloom.errors import ClaimError, CrsMismatchError, CrsMissingError, GateError
from gridloom.functions import claims, scalar as S
from gridloom.operators import facilities, flow, focal, learning, vector, zonal
from gridloom.plans import grid as G, laws


def cells_of(spark, z, valid=None, stream=None):
    h, w = len(z), len(z[0])
    rows = [(r * w + c, r, c, float(z[r][c]), bool(valid is None or valid[r][c]), bool(stream is not None and stream[r][c])) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "cell_id long, row int, col int, z double, valid boolean, stream boolean")


def as_grid(df, band, h, w):
    out = [[None] * w for _ in range(h)]
    for r in df.select("row", "col", band).collect():
        out[r[0]][r[1]] = r[2]
    return out


@pytest.mark.parametrize("zone,sub,flag,want", [("AE", "FLOODWAY", "T", 2), ("X", "floodway", "true", 2), ("AE", "", "", 1), ("x", "", "yes", 1), ("X", "", "F", 4), ("X", "AREA OF MINIMAL FLOOD HAZARD", "F", 4), ("X", "0.2 PCT ANNUAL CHANCE FLOOD HAZARD", "F", 3), ("X", "shaded", "F", 3), ("D", "", "F", 5), (None, None, None, 0), ("Open Water", "", "F", 0), ("AREA NOT INCLUDED", "", "", 0), ("B", "", "", 6), ("X", "FLOODWAY", "F", 4)])
def test_zone_codes(spark, zone, sub, flag, want):
    df = spark.createDataFrame([(zone, sub, flag)], "a string, b string, c string")
    assert df.select(S.classify_zone(F.col("a"), F.col("b"), F.col("c"))).first()[0] == want


def test_flat_grid_is_all_below_the_slope_floor(spark):
    s = focal.slope(cells_of(spark, [[200.0] * 8] * 8))
    assert s.agg(F.count_if(F.col("slope") < 0.001)).first()[0] == 64


def test_slope_counts_invalid_cells_as_the_median(spark):
    z = [[1.0, 2.0, 90.0], [1.0, 2.0, 3.0]]
    valid = [[1, 1, 0], [1, 1, 1]]
    got = as_grid(focal.slope(cells_of(spark, z, valid), cell=1.0), "slope", 2, 3)
    assert got[0][2] is None and got[0][1] == pytest.approx(math.atan(0.5))  # the median of 1, 2, 1, 2, 3 is 2; rows are alike


def test_a_slope_to_the_east_gathers_row_by_row(spark):
    """Nine rows fall by two to the east, the last column is a stream; row 4 has a step of seven more in the middle."""
    z = [[100.0 - 2 * c - (7 if r == 4 and c > 5 else 0) for c in range(12)] for r in range(9)]
    stream = [[c == 11 for c in range(12)] for _ in range(9)]
    c = focal.flow_direction(cells_of(spark, z, stream=stream))
    d = as_grid(c, "flowdir", 9, 12)
    assert all(d[r][k] == 2 for r in (0, 1, 7, 8) for k in range(11)) and d[3][5] == 3 and d[5][5] == 1 and d[0][11] == -2
    c = c.withColumn("down_id", flow.downstream(12))
    acc = {r.cell_id: r.acc for r in flow.flow_accumulation(c).collect()}
    assert acc[0 * 12 + 11] == acc[8 * 12 + 11] == 11 and acc[0] == 0 and acc[4 * 12 + 6] > 12
    hand = as_grid(flow.height_above_drainage(c), "hand", 9, 12)
    assert [row[11] for row in hand] == [0.0] * 9 and hand[0][0] == 22.0 and hand[4][0] == 29.0 and hand[3][5] == 12.0 + 7.0


def test_hand_follows_the_flow_and_clamps(spark):
    c = spark.createDataFrame([(0, 0, 0, 0.0, True, False, 1), (1, 0, 1, 5.0, True, True, None), (2, 1, 0, 3.0, True, False, 3), (3, 1, 1, 5.0, True, True, None), (4, 2, 0, 9.0, True, False, None)], "cell_id long, row int, col int, z double, valid boolean, stream boolean, down_id long")
    assert {r.cell_id: r.hand for r in flow.height_above_drainage(c).collect()} == {0: 0.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: None}


def test_filling_raises_pits_by_steps_whatever_the_tiles(spark):
    """A trench of three cells behind a lip of 8, two cells from the edge; its far end lies one step higher for each cell."""
    z = [[12.0] * 9 for _ in range(6)]
    for c, h in ((1, 8.0), (2, 3.0), (3, 2.0), (4, 3.0)):
        z[2][c] = h
    z[2][0] = 8.0
    whole = as_grid(flow.fill_depressions(cells_of(spark, z)), "filled", 6, 9)
    for tile in (2, 5):
        assert as_grid(flow.fill_depressions(cells_of(spark, z), tile=tile), "filled", 6, 9) == whole
    assert whole[2][:5] == pytest.approx([8.0, 8.001, 8.002, 8.003, 8.004]) and whole[3][3] == pytest.approx(12.0) and whole[0][0] == 12.0


def test_halo_is_a_cross(spark):
    c = cells_of(spark, [[0.0] * 5] * 5).withColumn("m", (F.col("row") == 2) & (F.col("col") == 2))
    assert focal.dilate(c, "m").where("halo").count() == 5


def test_leave_one_block_out(spark):
    c = cells_of(spark, [[0.0] * 5] * 5).withColumn("block_id", F.when(F.col("col") < 3, 1).otherwise(2)).withColumn("eligible", F.lit(True))
    n = {r.part: r.n for r in learning.leave_one_block_out(c, 1).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert n == {"test": 15, "halo": 5, "train": 5}


def test_distance_and_window(spark):
    c = cells_of(spark, [[float(r * 9 + k) for k in range(9)] for r in range(9)]).withColumn("m", (F.col("row") == 0) & (F.col("col") == 0))
    d = as_grid(focal.euclidean_distance(c, "m", 1.0), "distance", 9, 9)
    assert d[3][4] == 5.0 and d[0][0] == 0.0
    none = focal.euclidean_distance(c.withColumn("m", F.lit(False)), "m", 1.0)
    assert none.where("distance is not null").count() == 0
    p = spark.createDataFrame([(1, 0, 0), (2, -9, -9)], "key int, row int, col int")
    got = {r.key: (r.p_max, r.n_cells, r.max_row) for r in focal.window_stats(p, c, "z", ["key"], 2).collect()}
    assert got == {1: (20.0, 9, 2), 2: (None, 0, None)}


def test_spans_of_a_square_and_a_hole(spark):
    ring = lambda a, b: [{"x": a, "y": -a}, {"x": b, "y": -a}, {"x": b, "y": -b}, {"x": a, "y": -b}]
    f = spark.createDataFrame([(1, [ring(1.0, 5.0), ring(2.0, 4.0)]), (2, None), (3, [])], "feature int, rings array<array<struct<x:double,y:double>>>")
    got = vector.cells_of(vector.spans(vector.edges_of(f), 6, 6, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0))).count()
    assert got == 16 - 4


def test_borders_are_inside(spark):
    f = spark.createDataFrame([(1, [[{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 4.0}]])], "feature int, rings array<array<struct<x:double,y:double>>>")
    p = spark.createDataFrame([(1, 0.0, 2.0), (2, 4.0, 4.0), (3, 2.0, 4.0), (4, 2.0, 2.0), (5, 4.1, 2.0), (6, -1.0, 0.0)], "key int, x double, y double")
    assert {r.key for r in vector.points_in_polygons(p, vector.edges_of(f), ["key"]).collect()} == {1, 2, 3, 4}


def test_lines_touch_every_cell(spark):
    e = spark.createDataFrame([(1, 0.5, -0.5, 2.5, -1.5)], "feature int, x1 double, y1 double, x2 double, y2 double")
    assert {(r.row, r.col) for r in vector.touched_cells(e, 4, 4, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)).collect()} == {(0, 0), (0, 1), (1, 1), (1, 2)}


def test_headline_keeps_the_order_of_ties(spark):
    rows = [("mill", 0.31, 0.2, 4.0, 0), ("yard", 0.44, 0.1, 2.0, 1), ("dock", 0.31, 0.3, 4.0, 2), ("kiln", None, 0.3, 50.0, 3), ("shop", 0.31, 0.2, 6.0, 4), ("barn", 0.05, 0.05, 800.0, 5), ("pier", 0.4, None, 1.0, 6), ("loft", 0.06, 0.01, 0.0, 7)]
    d = spark.createDataFrame(rows, "name string, p_max double, p_mean double, on_site_release_lb double, ordinal int")
    assert [r.name for r in facilities.headline(d, "ordinal").collect()] == ["yard", "shop", "mill", "dock", "loft"]


def test_average_precision_groups_ties(spark):
    s = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 0)], "p double, y int")
    assert learning.average_precision(s).first().ap == pytest.approx((1 * 1 + 1 * 2 / 3) / 2)


def test_isotonic_is_monotone_and_clipped(spark):
    s = spark.createDataFrame([(0.1, 0, 1), (0.2, 1, 1), (0.3, 0, 2), (0.4, 1, 2)], "p double, y int, block_id int")
    got = [r.p_cal for r in learning.apply_isotonic(learning.isotonic(s), s).orderBy("p").collect()]
    assert got == pytest.approx([0.0, 0.5, 0.5, 1.0])
    assert got == pytest.approx([v for _, v in learning.pool([(0.1, 0, 1), (0.2, 1, 1), (0.3, 0, 1), (0.4, 1, 1)])])
    with pytest.raises(GateError):
        learning.isotonic_nested(s, [1])


def test_sample_keeps_all_positives(spark):
    c = cells_of(spark, [[0.0] * 10] * 10).withColumn("pos", F.col("cell_id") < 5).withColumn("near", F.col("cell_id").between(5, 12))
    s = learning.stratified_sample(c, "pos", "near", 2.0)
    n = s.agg(F.count("*").alias("n"), F.countDistinct("cell_id").alias("u"), F.count_if("pos").alias("p"), F.count_if("near").alias("k")).first()
    assert (n.n, n.u, n.p) == (15, 15, 5) and n.k >= 5


def test_grid_gates():
    g = G.GridSpec(3298, 3008, (30.0, 0.0, 692250.0, 0.0, -30.0, 2162790.0), kind=G.LIVE_KIND)
    assert g.validate().require_live().payload == "5070|3298|3008|30.0,0.0,692250.0,0.0,-30.0,2162790.0"
    for bad in (lambda: G.GridSpec.fixture().require_live(), lambda: G.GridSpec.at(0, 0, 1, 9).validate(), lambda: G.GridSpec.at(0, 0, 9, 9, 10.0).validate(), lambda: G.require_same_grid("a", "b")):
        with pytest.raises(GateError):
            bad()
    with pytest.raises(CrsMissingError):
        G.require_crs(None, 5070)
    with pytest.raises(CrsMismatchError):
        G.require_crs(4326, 5070)


def test_tiles_remain(spark):
    b = spark.createDataFrame([(0.0, 0.0, 90.0, 90.0, 3, 3)], "west double, south double, east double, north double, width int, height int")
    assert [(r.tile_w, r.tile_h) for r in G.tiles(b, 2).orderBy("row0", "col0").collect()] == [(2, 2), (1, 2), (2, 1), (1, 1)]


def test_laws():
    assert laws.stage_gate("0", "B") == ["stage_skip", "advance_on_fixture_template", "advance_without_firm_unshaded_x", "advance_without_stage_a"]
    assert laws.stage_gate("0", "A", laws.Facts(G.LIVE_KIND)) == [] and laws.stage_gate("Q", "A") == ["unknown_stage"]
    assert laws.stage_gate("C", "D", laws.Facts(G.LIVE_KIND, True, True, True)) == ["sample_p_before_isotonic"] == laws.stage_gate("B", "B", laws.Facts(G.LIVE_KIND, True, True, samples_p=True))
    assert laws.claim_flags({"note": "Unmapped risk", "p_definition": "other"}) == ["p_as_100yr_exceedance", "unmapped_risk"] and laws.claim_flags({}) == [] and laws.unit_lock(laws.REFUSED_UNIT) == ["parent_unit"]
    for bad in (lambda: laws.require_unit("", "IN", None), lambda: laws.require_unit(laws.UNIT, "OH", None), lambda: laws.require_unit(laws.UNIT, "IN", 3.0), lambda: laws.require_report({"stage": "A", "gate": "fail"}, "A"), lambda: laws.require_all_features("zone = 'X'"), lambda: laws.require_overlay_report({})):
        with pytest.raises(GateError):
            bad()
    with pytest.raises(ClaimError):
        claims.require_clean("two people killed", "text")


def test_claims(spark):
    d = spark.createDataFrame([("100-year exceedance — yes",), (None,), ("clean",), ("Fgf llc",)], "t string")
    assert [r[0] for r in d.select(claims.scan(F.col("t"), claims.BANNED_NAMES)).collect()] == [["p_as_100yr", "em_dash"], [], [], ["indy_plant_copy"]]
    assert claims.scan_text("100-year exceedance — yes") == ["p_as_100yr", "em_dash"]


def test_zonal_gates(spark):
    c = spark.createDataFrame([(2, 0), (4, 1)], "zone int, sfha int")
    with pytest.raises(GateError):
        zonal.require_floodway_in_sfha(c)
    with pytest.raises(GateError):
        zonal.require_both_classes(c.where("sfha = 1"))
    assert zonal.require_unshaded_majority(c.where("zone = 4"), True) is not None


def test_calibration_rule():
    assert learning.choose_calibration(0.27, 0.265, 0.2) == ("nested", 0.265)
    assert learning.choose_calibration(0.27, 0.22, 0.265) == ("pooled", 0.265)
    with pytest.raises(GateError):
        learning.choose_calibration(0.27, 0.2, 0.2)


def test_boosted_trees_is_the_operators_own_fit(spark, monkeypatch):
    from gridloom.plans import queries as Q

    seen = []
    monkeypatch.setattr(learning, "predict", lambda model, rows, f=learning.predict: seen.append((model, rows)) or f(model, rows))
    out = Q.boosted_trees(spark, "/root/testdata/sf0.001")
    (assembler, gbt), rows = seen[0][0].stages, seen[0][1]
    assert tuple(assembler.getInputCols()) == learning.FEATURES and gbt.getNumTrees == 160 and gbt.getOrDefault("stepSize") == 0.05 and gbt.getOrDefault("maxBins") == 128
    assert out.count() == rows.where("hand is not null and twi is not null").count() > 0
    p = {r.cell_id: r.p for r in out.collect()}
    assert min(p.values()) < 0.1 and max(p.values()) > 0.9


def test_calibration_over_all_events_is_brute_forces(spark):
    import numpy as np

    from gridloom.plans import queries as Q

    d = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{d}/events.parquet").toPandas()
    v = e["value"].to_numpy(float)
    p, y, block = v / 500, ((e["event_id"] * 37) % 100 < v / 3).to_numpy(float), (e["user_id"] % 3 + 1).to_numpy()
    assert len(set(p)) > 0.9 * len(p) and e["event_type"].nunique() > 1

    def fitted(p, y):
        """The greatest, over starts up to x, of the least, over ends from x on, of the mean."""
        x = np.unique(p)
        at = np.searchsorted(x, p)
        s, w = (np.concatenate(([0], np.cumsum(np.bincount(at, c)))) for c in (y, np.ones(len(y))))
        best = np.full(len(x), -np.inf)
        for j in range(len(x)):
            means = (s[j + 1 :] - s[j]) / (w[j + 1 :] - w[j])
            best[j:] = np.maximum(best[j:], np.minimum.accumulate(means[::-1])[::-1])
        return x, best

    def precision(p, y):
        steps = [(y[p == t].sum(), y[p >= t].mean()) for t in np.unique(p)]
        return sum(a * b for a, b in steps) / y.sum()

    pooled, nested = np.interp(p, *fitted(p, y)), np.zeros(len(p))
    for b in (1, 2, 3):
        nested[block == b] = np.interp(p[block == b], *fitted(p[block != b], y[block != b]))
    for name, want in (("isotonic_pooled_all", pooled), ("isotonic_nested_all", nested)):
        out = {r.event_id: r.p_cal for r in Q.QUERIES[name](spark, d).collect()}
        assert len(out) == len(e) and [out[i] for i in e["event_id"]] == pytest.approx(list(want), abs=2e-6), name
    raw, near, far = precision(p, y), precision(nested.round(12), y), precision(pooled.round(12), y)
    want = ("nested", near) if abs(near - raw) <= 0.02 else ("pooled", far) if abs(far - raw) <= 0.02 else ("refused", None)
    got = Q.calibration_choice_all(spark, d).first()
    print(raw, near, far, got)
    assert got.chosen == want[0] and got.ap_raw == pytest.approx(raw, abs=1e-6) and (got.ap_chosen is None or got.ap_chosen == pytest.approx(want[1], abs=1e-3))


def test_distance_to_every_stream_is_brute_forces(spark):
    import numpy as np

    from gridloom.plans import queries as Q, substrate as B

    d = "/root/testdata/sf0.001"
    c = B.cells(spark, d).select("cell_id", "row", "col", "stream", "block_id").toPandas()
    m = c[c["stream"]]
    assert m["block_id"].nunique() > 2
    want = np.sqrt(((c["row"].to_numpy()[:, None] - m["row"].to_numpy()) ** 2 + (c["col"].to_numpy()[:, None] - m["col"].to_numpy()) ** 2).min(1)) * 30
    got = {r.cell_id: r.distance for r in Q.QUERIES["edt_stream_all"](spark, d).collect()}
    assert [got[i] for i in c["cell_id"]] == pytest.approx(list(want), abs=1e-5)


def test_flow_refuses_circles_and_discards_rounds(spark):
    from gridloom.session import discard, stored

    rows = [(0, 1), (1, 2), (2, 0), (3, 2), (4, None)]
    c = spark.createDataFrame([(a, b, 1.0, True, False) for a, b in rows], "cell_id long, down_id long, z double, valid boolean, stream boolean")
    for f in (flow.flow_accumulation, flow.height_above_drainage):
        with pytest.raises(GateError):
            f(c)
    chain = spark.createDataFrame([(i, i + 1 if i < 36 else None, True) for i in range(37)] + [(99, 500, True)], "cell_id long, down_id long, valid boolean")
    assert {r.cell_id: r.acc for r in flow.flow_accumulation(chain).collect()} == {i: i for i in range(37)} | {99: 0}
    one = stored(chain, "once")
    (folder,) = {f.rsplit("/", 1)[0] for f in one.inputFiles()}
    assert Path(folder.split(":", 1)[1].replace("//", "")).exists()
    discard(one)
    assert not Path(folder.split(":", 1)[1].replace("//", "")).exists()


def test_depressions_are_flooded_on_from_tile_to_tile(spark):
    import random

    r = random.Random(5)
    z = [[r.choice([1.0, 5.0, 9.0]) + r.random() for _ in range(23)] for _ in range(17)]
    whole = as_grid(flow.fill_depressions(cells_of(spark, z)), "filled", 17, 23)
    for tile in (3, 8):
        assert as_grid(flow.fill_depressions(cells_of(spark, z), tile=tile), "filled", 17, 23) == whole


def test_nearest_squares_are_brute_forces():
    import numpy as np

    r = np.random.default_rng(3)
    for width, share in ((1, 0.5), (7, 0.3), (40, 0.05), (40, 0.9)):
        row = np.repeat(np.arange(5, 45), width)
        col = np.tile(np.arange(-3, width - 3), 40)
        here = r.random(len(row)) < 0.8
        row, col = row[here], col[here]
        g = np.where(r.random(len(row)) < share, r.integers(0, 60, len(row)), np.nan)
        want = [np.nanmin(np.append(((col[i] - col) ** 2 + g**2)[row == row[i]], np.inf)) for i in range(len(row))]
        got = focal.nearest_squares(row, col, g)
        assert np.where(np.isnan(got), np.inf, got).tolist() == want


def test_distances_in_tall_grids_read_no_column_over_and_over(spark, monkeypatch):
    monkeypatch.setattr(focal, "CELLS_AT_ONCE", 1000)
    c = spark.range(120_000).selectExpr("cast(id / 2 as int) as row", "cast(id % 2 as int) as col", "id = 7 as m")
    far = focal.euclidean_distance(c, "m", 1.0)
    assert "unboundedfollowing" not in far._jdf.queryExecution().toString().lower()
    got = far.selectExpr("sum(distance) as s", "count(distance) as n").first()
    assert got.n == 120_000 and got.s == pytest.approx(sum(((i // 2 - 3) ** 2 + (i % 2 - 1) ** 2) ** 0.5 for i in range(120_000)), rel=1e-9)


@pytest.mark.parametrize("bits", (0, 3, 18))
def test_flow_crosses_blocks_of_ids(spark, bits, monkeypatch):
    """Paths that leave blocks and come back, against a walk cell by cell; all cells are in a table a fixed number of times, however long the paths."""
    import random

    r = random.Random(bits)
    order = r.sample(range(-20, 60), 60)
    down = {c: r.choice([None, 999, *order[i + 1 : i + 4]]) for i, c in enumerate(order)}
    down |= {100 + i: 101 + i for i in range(40)} | {140: None}
    stream = {c: r.random() < 0.1 for c in down}
    acc, drain = dict.fromkeys(down, 0), {}
    for c in down:
        at, met = c, []
        while at in down:
            met.append(at)
            at = down[at]
        drain[c] = next((m for m in met if stream[m]), None)
        for m in met[1:]:
            acc[m] += 1
    cells = spark.createDataFrame([(c, down[c], True, stream[c]) for c in down] + [(500, 100, False, True)], "cell_id long, down_id long, valid boolean, stream boolean")
    sizes = []
    monkeypatch.setattr(flow, "stored", lambda df, name, f=flow.stored: sizes.append((t := f(df, name)).count()) or t)
    assert {x.cell_id: x.acc for x in flow.flow_accumulation(cells, bits=bits).collect()} == acc
    assert {x.cell_id: x.drain_id for x in flow.drainage(cells, bits=bits).collect()} == drain
    assert bits == 0 or sum(n == len(down) for n in sizes) <= 3
    circle = spark.createDataFrame([(0, 9, True, False), (9, 17, True, False), (17, 0, True, False), (3, 0, True, False)], cells.schema)
    for f in (flow.flow_accumulation, flow.drainage):
        with pytest.raises(GateError):
            f(circle, bits=bits)


def test_the_median_is_exact_whatever_the_ties(spark, monkeypatch):
    import random

    import numpy as np

    monkeypatch.setattr(focal, "VALUES_AT_ONCE", 20)
    r = random.Random(2)
    for v in ([r.random() for _ in range(3000)], [float(r.randrange(40)) for _ in range(2001)], [5.0] * 50 + [7.0] * 50, [None, 4.0, None, 1.0], [None]):
        some = [x for x in v if x is not None]
        assert focal.median(spark.createDataFrame([(x,) for x in v], "v double"), "v") == (np.median(some) if some else None)
