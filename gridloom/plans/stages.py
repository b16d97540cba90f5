"""The five stages. Each takes tables and upstream reports, checks its laws first, writes its bands, and returns a report.

Bands are cell tables below `out`; nothing is fetched here: features, elevations and release rows come as tables (see `sources`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions import scalar as S
from gridloom.functions.claims import BANNED_NAMES
from gridloom.operators import facilities, flow, focal, learning, vector, zonal
from gridloom.plans import laws
from gridloom.plans.grid import LIVE_KIND, GridSpec, require_same_grid
from gridloom.session import stored
from gridloom.sources.geojson import load_unit
from gridloom.sources.tables import read_cells, write_cells, write_report

# Fixed values.
STREAM_TYPES, AREA_TYPES = (460, 558), (460,)
REFUSED_PATHS = ("nora", "indy")
#: Where a feature's class, zone and subtype may stand.
ZONE_KEYS = {"zone": ("fld_zone", "FLD_ZONE"), "subtype": ("zone_subty", "ZONE_SUBTY"), "sfha": ("sfha_tf", "SFHA_TF")}


def base_report(stage: str, unit: dict, grid: GridSpec, **more) -> dict:
    report = {"stage": stage, "gate": "pass", "huc8": unit["huc8"], "huc_name": unit["name"], "states": unit["states"], "vector_crs": unit["crs"], "grid_crs": grid.crs, "grid_shape": [grid.height, grid.width], "grid_kind": grid.kind, "grid_sha256": grid.fingerprint(), **more}
    laws.require(laws.unit_lock(unit["huc8"]), "unit")
    laws.require(laws.claim_flags(report), "claims")
    return report


def full(grid: GridSpec) -> bool:
    """Whether a grid is of the size of a whole unit and not a window."""
    return grid.width >= 1000 and grid.height >= 1000


def fill(polygons: DataFrame, grid: GridSpec, value: str, order: str) -> DataFrame:
    return vector.rasterize(vector.project_rings(polygons), value, order, grid.height, grid.width, grid.transform)


def inside_of(unit: DataFrame, grid: GridSpec) -> DataFrame:
    return fill(unit.select((F.col("ordinal")).alias("o"), F.lit(1).alias("inside"), "rings"), grid, "inside", "o").select("row", "col")


def prop(*names: str):
    return F.coalesce(*[F.element_at("props", n) for n in names])


def passed(report: dict) -> bool:
    return report.get("gate") == "pass"


def run_stage_0(spark: SparkSession, unit_path: str, grid: GridSpec, out: str, wkid: int | None = None) -> dict:
    _, unit = load_unit(spark, unit_path, wkid)
    if grid.kind != "fixture":
        grid.validate()
    laws.require(laws.stage_gate("0", "0", laws.Facts(grid.kind)), "stages")
    report = base_report("0", unit, grid)
    write_report(spark, report, out)
    return report


def run_stage_a(spark: SparkSession, unit_path: str, grid: GridSpec, zones: DataFrame, out: str, samples: DataFrame | None = None, wkid: int | None = None) -> dict:
    """zones: ordinal, props, rings of flood zones, all of them. samples: key, lon, lat, zone_class that the bands must show."""
    grid.validate().require_live()
    laws.require(laws.stage_gate("0", "A", laws.Facts(grid.kind)), "stages")
    unit, about = load_unit(spark, unit_path, wkid)
    code = S.classify_zone(prop(*ZONE_KEYS["zone"]), prop(*ZONE_KEYS["subtype"]), prop(*ZONE_KEYS["sfha"]))
    rank = F.array_position(F.array(*[F.lit(z) for z in (S.UNMAPPED, *S.PAINT_ORDER)]), code)
    keyed = zones.withColumn("zone", code).withColumn("o", rank.cast("long") * (1 << 40) + F.col("ordinal"))
    painted = fill(keyed, grid, "zone", "o")
    cells = inside_of(unit, grid).join(painted, ["row", "col"], "left").select("row", "col", F.coalesce("zone", F.lit(S.UNMAPPED)).alias("zone"))
    write_cells(cells.withColumn("sfha", S.sfha_band(F.col("zone"))), f"{out}/zones", grid)
    cells = read_cells(spark, f"{out}/zones")
    zonal.require_both_classes(zonal.require_floodway_in_sfha(cells))
    zonal.require_unshaded_majority(cells, full(grid))
    if samples is not None:
        laws.require_samples([(r.key, r.lon, r.lat, r.zone_class) for r in samples.select("key", "lon", "lat", "zone_class").collect()])  # a few named points
        x, y = S.albers(F.col("lon"), F.col("lat"))
        row, col = S.cell_of(x, y, grid.transform)
        at = samples.select("key", "zone_class", row.alias("row"), col.alias("col")).join(cells, ["row", "col"], "left")
        laws.require([f"gate_sample_{r.key}" for r in at.where(S.zone_name(F.col("zone")) != F.col("zone_class")).collect()], "gate samples")
    n = {r.zone_class: r.n for r in zonal.histogram(cells).collect()}
    report = base_report("A", about, grid, zone_counts=n, unshaded_x_ok=n.get("unshaded_x", 0) > 0)
    write_report(spark, report, out)
    return report


def run_stage_b(spark: SparkSession, grid: GridSpec, unit: dict, elevation: DataFrame, flowlines: DataFrame, waterbodies: DataFrame, areas: DataFrame, stage_a: dict, zones_path: str, out: str, paths: tuple[str, ...] = ()) -> dict:
    """elevation: row, col, z. Features carry ordinal, props (with ftype) and rings."""
    laws.require_paths(list(paths), REFUSED_PATHS)
    laws.require_report(stage_a, "A", unit["huc8"], grid.validate().require_live().fingerprint())
    laws.require(laws.stage_gate("A", "B", laws.Facts(grid.kind, stage_a["unshaded_x_ok"], passed(stage_a))), "stages")
    kind = prop("ftype", "FTYPE").cast("int")
    size = (grid.height, grid.width, grid.transform)

    def touched(features: DataFrame, types: tuple[int, ...] | None, filled: bool) -> DataFrame:
        some = features if types is None else features.where(kind.isin(*types))
        edges = vector.edges_of(vector.project_rings(some.withColumn("feature", F.col("ordinal"))))
        cells = vector.touched_cells(edges, *size)
        return cells.union(vector.cells_of(vector.spans(edges, *size)).select("row", "col")).distinct() if filled else cells

    mark = lambda df, name: df.withColumn(name, F.lit(True))
    inside = read_cells(spark, zones_path).select("row", "col")
    c = focal.dense(mark(inside, "inside"), grid.height, grid.width).join(elevation, ["row", "col"], "left")
    for df, name in ((touched(flowlines, STREAM_TYPES, False), "flowline"), (touched(waterbodies, None, True), "waterbody"), (touched(areas, AREA_TYPES, True), "area")):
        c = c.join(mark(df, name), ["row", "col"], "left")
    c = c.withColumn("valid", F.coalesce("inside", F.lit(False)) & S.defined(F.col("z"))).withColumn("stream", F.col("valid") & zonal.mask_union(F.col("flowline"), F.col("waterbody"), F.col("area")))
    c = stored(c.withColumn("cell_id", F.col("row").cast("long") * grid.width + F.col("col")).withColumn("burned", S.burn(F.col("z"), F.col("stream"))), "masks")
    c = focal.slope(c, "z")
    c = flow.fill_depressions(c, "burned")
    c = stored(focal.flow_direction(c, "filled").withColumn("down_id", flow.downstream(grid.width)), "routed")
    c = c.join(flow.flow_accumulation(c), "cell_id", "left").withColumn("twi", S.wetness(S.specific_catchment(F.col("acc")), F.col("slope")))
    flow.require_finite(c, "twi")
    c = stored(flow.height_above_drainage(c, "z"), "drained")
    for name in ("flowline", "waterbody"):
        c = focal.euclidean_distance(c.withColumn("_m", F.coalesce(F.col(name), F.lit(False))), "_m").withColumnRenamed("distance", f"dist_{name}").drop("_m")
    bands = c.where("valid").select("row", "col", *[F.col(b).cast("float").alias(b) for b in ("hand", "slope", "twi", "dist_flowline", "dist_waterbody")])
    write_cells(bands, f"{out}/bands", grid)
    n = c.agg(F.count_if("valid").alias("n_interior"), F.count_if("stream").alias("n_stream"), F.count_if(F.col("valid") & F.col("hand").isNull()).alias("n_hand_undefined"), F.count_if(F.col("valid") & (F.col("slope") < S.SLOPE_FLOOR)).alias("n_slope_floored"), F.min(F.when(F.col("valid"), F.col("z"))).alias("dem_min"), F.max(F.when(F.col("valid"), F.col("z"))).alias("dem_max")).first().asDict()
    if full(grid):
        laws.require_area_pin(n["n_interior"] * 900 / 1e6)
    types = {str(r.ftype): r.n for r in zonal.type_counts(flowlines).collect()}
    report = base_report("B", unit, grid, **n, flowline_ftype_counts=types)
    write_report(spark, report, out)
    return report


def run_stage_c(spark: SparkSession, grid: GridSpec, unit: dict, blocks: DataFrame, stage_a: dict, stage_b: dict, zones_path: str, bands_path: str, out: str, **model) -> dict:
    """blocks: ordinal, props (with huc10), rings. model: changes to the classifier's parameters."""
    print_ = grid.validate().require_live().fingerprint()
    laws.require_report(stage_a, "A", unit["huc8"], print_)
    laws.require_report(stage_b, "B", unit["huc8"], print_)
    laws.require(laws.stage_gate("B", "C", laws.Facts(grid.kind, stage_a["unshaded_x_ok"], passed(stage_a), passed(stage_b))), "stages")
    legend = [r.huc10 for r in blocks.select("ordinal", prop("huc10", "HUC10").alias("huc10")).orderBy("ordinal").collect()]
    laws.require([f"block_{x}" for x in legend if not str(x or "").startswith(unit["huc8"])], "blocks")
    numbered = blocks.withColumn("block_id", (F.col("ordinal") + 1).cast("int"))
    block = fill(numbered.withColumn("o", F.col("block_id")), grid, "block_id", "o")
    c = focal.dense(read_cells(spark, bands_path).join(read_cells(spark, zones_path), ["row", "col"]), grid.height, grid.width).join(block, ["row", "col"], "left")
    c = c.withColumn("block_id", F.coalesce("block_id", F.lit(0))).withColumn("cell_id", F.col("row").cast("long") * grid.width + F.col("col"))
    c = c.withColumn("eligible", S.eligible(F.col("hand"), F.col("sfha"))).withColumn("y", F.col("sfha")).withColumn("pos", F.col("y") == 1)
    # distances to a layer without features are unknown; trees need a number
    c = c.withColumn("dist_flowline", F.coalesce("dist_flowline", F.lit(-1.0).cast("float"))).withColumn("dist_waterbody", F.coalesce("dist_waterbody", F.lit(-1.0).cast("float")))
    c = stored(c.withColumn("near", S.near_stream_unshaded(F.col("zone"), F.col("dist_flowline"), F.col("dist_waterbody"))), "stack")
    ids, p, folds = [r.block_id for r in c.where("eligible and block_id > 0").select("block_id").distinct().orderBy("block_id").collect()], None, []
    for b in ids:
        split = learning.leave_one_block_out(c, b)
        sample = stored(learning.stratified_sample(split.where("part = 'train'"), "pos", "near", seed=learning.SEED + b), "sample")
        fitted = learning.fit_classifier(sample, learning.FEATURES, "y", b, **model)
        part = learning.predict(fitted, split.where("part = 'test'")).select("row", "col", "p")
        p = part if p is None else p.union(part)
        folds.append({"block": b, "n_train": sample.count()})
    scored = stored(c.where("eligible").join(p, ["row", "col"]).select("row", "col", "block_id", "y", "p", "hand"), "scores")
    ap = lambda df, col: learning.average_precision(df, col).first().ap
    raw, m = ap(scored, "p"), learning.brier(scored).first()
    if raw <= m.prevalence:
        laws.require(["no_skill"], "metrics")
    nested, pooled = stored(learning.isotonic_nested(scored, ids), "nested"), stored(learning.apply_isotonic(learning.isotonic(scored), scored), "pooled")
    ap_nested, ap_pooled = ap(nested, "p_cal"), ap(pooled, "p_cal")
    name, ap_cal = learning.choose_calibration(raw, ap_nested, ap_pooled)
    chosen = {"nested": nested, "pooled": pooled}[name]
    zonal.require_different(chosen.select("row", "col", F.col("p").cast("double").alias("v")), chosen.select("row", "col", F.col("p_cal").alias("v")), "raw and calibrated scores")
    zonal.require_undefined_empty(c, chosen, ("p", "p_cal"))
    write_cells(chosen.select("row", "col", "p", F.col("p_cal").cast("float").alias("p_cal")), f"{out}/p", grid)
    zonal.require_unchanged(scored, read_cells(spark, f"{out}/p"), "p")
    cal = learning.brier(chosen, "p_cal").first()
    report = base_report("C", unit, grid, p_definition=laws.P_DEFINITION, probabilities_calibrated=True, calibration=name, ap_raw=raw, ap_nested=ap_nested, ap_pooled=ap_pooled, ap_calibrated=ap_cal, ap_hand=ap(scored.withColumn("_h", -F.col("hand")), "_h"), prevalence=m.prevalence, brier_raw=m.brier, brier_constant=m.brier_constant, brier_calibrated=cal.brier, calibrated_in_sample=name == "pooled", folds=folds, blocks=legend, upstream={"A": stage_a["gate"], "B": stage_b["gate"], "unshaded_x_ok": stage_a["unshaded_x_ok"]})
    write_report(spark, report, out)
    return report


def run_stage_d(spark: SparkSession, grid: GridSpec, unit: dict, unit_polygons: DataFrame, sites: DataFrame, year: int, stage_c: dict, zones_path: str, bands_path: str, p_path: str, out: str) -> dict:
    """sites: facilities of one year (see facilities.rollup), clipped here to the unit."""
    laws.require_report(stage_c, "C", unit["huc8"], grid.fingerprint())
    require_same_grid(stage_c["grid_sha256"], grid.fingerprint())
    before = stage_c.get("upstream") or {}
    laws.require(laws.stage_gate("C", "D", laws.Facts(grid.kind, bool(before.get("unshaded_x_ok")), before.get("A") == "pass", before.get("B") == "pass", bool(stage_c.get("probabilities_calibrated")), True)), "stages")
    edges = vector.edges_of(unit_polygons.withColumn("feature", F.col("ordinal")))
    here = vector.points_in_polygons(facilities.refuse_names(sites, BANNED_NAMES), edges, ["key"], "lon", "lat")
    x, y = S.albers(F.col("lon"), F.col("lat"))
    row, col = S.cell_of(x, y, grid.transform)
    points = here.withColumn("row", row).withColumn("col", col)
    bands = read_cells(spark, zones_path).join(read_cells(spark, bands_path).select("row", "col", "dist_flowline", "dist_waterbody"), ["row", "col"], "left")
    rows = stored(facilities.overlay(points, read_cells(spark, p_path).select("row", "col", F.col("p_cal").alias("p")), bands, ["key"]), "overlay")
    d1 = rows.where("d1")
    top = facilities.require_headline(d1, facilities.headline(d1, "key"))
    fields = ("name", "p_max", "p_mean", "on_site_release_lb")
    head = [{f: r[f] for f in fields} for r in top.collect()]
    n, n_d1 = rows.count(), d1.count()
    report = base_report("D", unit, grid, p_definition=laws.P_DEFINITION, p_source="p_cal (calibrated)", reporting_year=year, n_tris_huc_year=n, d1_n_unshaded_x=n_d1, n_not_d1=n - n_d1, not_d1_by_zone={r.zone_class: r.n for r in facilities.not_d1_by_zone(rows).collect()}, d1_headline_rows=head)
    laws.require_overlay_report(report, names=BANNED_NAMES)
    for name, df in (("facilities", rows), ("d1", d1), ("d1_headline", top)):
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/{name}")
    write_report(spark, report, out)
    return report


__all__ = ["LIVE_KIND", "run_stage_0", "run_stage_a", "run_stage_b", "run_stage_c", "run_stage_d"]
