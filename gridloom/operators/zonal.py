"""Aggregates over masks and zones, set operations on masks, and gates that read one aggregate row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.errors import GateError
from gridloom.functions.scalar import FLOODWAY, UNSHADED_X, ZONES, zone_name


def histogram(cells: DataFrame, code: str = "zone", inside: Column | None = None) -> DataFrame:
    """zone_class, n of the known codes inside."""
    rows = cells if inside is None else cells.where(inside)
    return rows.where(F.col(code).isin(*ZONES)).groupBy(zone_name(F.col(code)).alias("zone_class")).agg(F.count("*").alias("n"))


def counts(cells: DataFrame, **masks: Column) -> DataFrame:
    """One row with the number of cells of each mask."""
    return cells.agg(*[F.count_if(F.coalesce(m, F.lit(False))).alias(k) for k, m in masks.items()])


def area_sqkm(n: Column, cell: float = 30.0) -> Column:
    return n * (cell * cell) / 1e6


def mask_union(*masks: Column) -> Column:
    out = F.lit(False)
    for m in masks:
        out = out | F.coalesce(m, F.lit(False))
    return out


def mask_difference(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) & ~F.coalesce(b, F.lit(False))


def dedupe_features(features: DataFrame, key: str, order: str) -> DataFrame:
    """The first feature of each id; features without one all stay."""
    known = features.where(F.col(key).isNotNull())
    first = known.groupBy(key).agg(F.min_by(F.struct(*features.columns), order).alias("_x")).select("_x.*")
    return first.unionByName(features.where(F.col(key).isNull()))


def require_floodway_in_sfha(cells: DataFrame, zone: str = "zone", sfha: str = "sfha") -> DataFrame:
    if not cells.where((F.col(zone) == FLOODWAY) & ~F.coalesce(F.col(sfha) == 1, F.lit(False))).isEmpty():
        raise GateError("floodway cells are missing from the hazard band")
    return cells


def require_both_classes(cells: DataFrame, sfha: str = "sfha") -> DataFrame:
    n = cells.agg(F.count_if(F.col(sfha) == 0).alias("no"), F.count_if(F.col(sfha) == 1).alias("yes")).first()
    if not n.no or not n.yes:
        raise GateError("the hazard band has one class only")
    return cells


def require_unshaded_majority(cells: DataFrame, full_grid: bool, zone: str = "zone") -> DataFrame:
    """On a full grid, unshaded X is the most frequent zone."""
    if full_grid:
        top = cells.where(F.col(zone).isNotNull()).groupBy(zone).count().orderBy(F.desc("count"), zone).first()
        if top is None or top[zone] != UNSHADED_X:
            raise GateError("unshaded X is not the largest zone")
    return cells


def require_different(a: DataFrame, b: DataFrame, what: str) -> None:
    """Two bands (row, col, v) that must not be equal: one cell that differs will do."""
    there = a.withColumnRenamed("v", "_a").join(b.withColumnRenamed("v", "_b"), ["row", "col"], "full")
    if there.where(~F.col("_a").eqNullSafe(F.col("_b"))).limit(1).isEmpty():
        raise GateError(f"{what} are equal")


def type_counts(features: DataFrame) -> DataFrame:
    """ftype, n of features by the property that says their type (empty if it is missing)."""
    kind = F.coalesce(F.element_at("props", "ftype"), F.element_at("props", "FTYPE"), F.lit(""))
    return features.groupBy(kind.alias("ftype")).agg(F.count("*").alias("n"))


def require_undefined_empty(cells: DataFrame, scored: DataFrame, bands: tuple[str, ...], hand: str = "hand") -> None:
    """Cells without a height above drainage must have no score."""
    undefined = cells.where(F.col(hand).isNull() | F.isnan(hand)).select("row", "col")
    filled = scored.where(F.coalesce(*bands).isNotNull()).select("row", "col")
    if not undefined.join(filled, ["row", "col"], "left_semi").limit(1).isEmpty():
        raise GateError("cells without a height above drainage were given a score")


def require_unchanged(before: DataFrame, after: DataFrame, band: str) -> None:
    """Calibration must leave the raw scores as they were."""
    pair = before.select("row", "col", F.col(band).cast("float").alias("_a")).join(after.select("row", "col", F.col(band).cast("float").alias("_b")), ["row", "col"])
    if not pair.where(~F.col("_a").eqNullSafe(F.col("_b"))).limit(1).isEmpty():
        raise GateError(f"{band} was overwritten")
