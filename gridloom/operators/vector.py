"""Vector to raster: polygon spans by the centre rule, paint order, point in polygon, and all-touched masks.

Geometry is a table of edges (feature, x1, y1, x2, y2); rings need not be told apart, since a row's crossings are paired
by the even-odd rule. Edges meet only the rows that they span, so nothing is compared with everything.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.functions.scalar import albers
from gridloom.session import ship


def edges_of(features: DataFrame, rings: str = "rings", key: str = "feature") -> DataFrame:
    """feature, x1, y1, x2, y2 of rings: array of arrays of struct<x, y>; unclosed rings are closed, null and empty ones have no edges."""
    ring = features.select(key, F.explode(rings).alias("_r"))
    n = F.size("_r")
    points = ring.where(n > 1).select(key, F.posexplode("_r").alias("_i", "_p"), "_r", n.alias("_n"))
    after = F.element_at("_r", F.when(F.col("_i") + 1 < F.col("_n"), F.col("_i") + 2).otherwise(1))
    return points.select(key, F.col("_p.x").alias("x1"), F.col("_p.y").alias("y1"), after["x"].alias("x2"), after["y"].alias("y2"))


def project_rings(features: DataFrame, rings: str = "rings") -> DataFrame:
    """Vertices from EPSG:4269 to EPSG:5070; no points are added along edges."""

    def point(p):
        x, y = albers(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return features.withColumn(rings, F.transform(rings, lambda r: F.transform(r, point)))


def spans(edges: DataFrame, height: int, width: int, transform: tuple, key: str = "feature") -> DataFrame:
    """feature, row, c0, c1: runs of cells whose centres lie inside. Edges are half open in y, so shared borders belong to one side."""
    a, _, c, _, e, f = transform
    u = lambda y: (F.col(y) - f) / e - 0.5  # noqa: E731  row numbers whose centres have this y
    lo, hi = F.least(u("y1"), u("y2")), F.greatest(u("y1"), u("y2"))
    first, last = F.greatest(F.ceil(lo), F.lit(0)), F.least(F.ceil(hi) - 1, F.lit(height - 1))
    e_rows = edges.where("y1 <> y2").withColumn("_f", first).withColumn("_l", last).where("_f <= _l")
    e_rows = e_rows.withColumn("row", F.explode(F.sequence("_f", "_l")))
    y = F.lit(f) + (F.col("row") + 0.5) * F.lit(e)
    x = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    cross = e_rows.select(key, F.col("row").cast("int").alias("row"), x.alias("x"))
    w = Window.partitionBy(key, "row").orderBy("x")
    paired = cross.withColumn("_k", F.row_number().over(w)).withColumn("_x2", F.lead("x").over(w)).where(F.col("_k") % 2 == 1)
    col = lambda v: (v - c) / a - 0.5
    c0 = F.greatest(F.ceil(col(F.col("x"))), F.lit(0)).cast("int")
    c1 = F.least(F.ceil(col(F.col("_x2"))) - 1, F.lit(width - 1)).cast("int")
    return paired.select(key, "row", c0.alias("c0"), c1.alias("c1")).where("c0 <= c1")


def cells_of(span_rows: DataFrame) -> DataFrame:
    """A row per cell of the spans."""
    return span_rows.withColumn("col", F.explode(F.sequence("c0", "c1"))).drop("c0", "c1")


def paint(cells: DataFrame, value: str, order: str) -> DataFrame:
    """row, col, value: of all that cover a cell, the last in painting order."""
    return cells.groupBy("row", "col").agg(F.max_by(value, order).alias(value))


def rasterize(features: DataFrame, value: str, order: str, height: int, width: int, transform: tuple, rings: str = "rings") -> DataFrame:
    """row, col, value of features painted in order, by the centre rule."""
    keyed = features.withColumn("feature", F.col(order))
    found = cells_of(spans(edges_of(keyed), height, width, transform)).join(keyed.select("feature", F.col(value), F.col(order).alias("_o")).dropDuplicates(["feature"]), "feature")
    return paint(found, value, "_o")


def points_in_polygons(points: DataFrame, edges: DataFrame, keys: list[str], x: str = "x", y: str = "y", band: float | None = None) -> DataFrame:
    """The points inside any polygon of `edges` or on a border. Points and edges meet by bands of y, as an equi-join."""
    if band is None:
        extent = edges.agg(F.min(F.least("y1", "y2")).alias("lo"), F.max(F.greatest("y1", "y2")).alias("hi"), F.count("*").alias("n")).first()
        band = max((extent.hi - extent.lo) / 256, 1e-12) if extent.n else 1.0
    at = lambda c: F.floor(c / band).cast("long")
    banded = edges.withColumn("_b", F.explode(F.sequence(at(F.least("y1", "y2")), at(F.greatest("y1", "y2")))))
    p = points.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).withColumn("_b", at(F.col("_y")))
    j = p.join(banded, "_b")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    crosses = (low <= F.col("_y")) & (F.col("_y") < high)
    right = F.col("x1") + (F.col("_y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")) > F.col("_x")
    area = (F.col("x2") - F.col("x1")) * (F.col("_y") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("_x") - F.col("x1"))
    on = (area == 0) & F.col("_x").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("_y").between(low, high)
    per = j.groupBy(*keys, "feature").agg(F.sum(F.when(crosses & right, 1).otherwise(0)).alias("_n"), F.max(on).alias("_on"))
    inside = per.where((F.col("_n") % 2 == 1) | F.col("_on")).select(*keys).distinct()
    return points.join(inside, keys, "left_semi")


def touched_cells(edges: DataFrame, height: int, width: int, transform: tuple) -> DataFrame:
    """row, col of every cell that a line passes (all touched); for polygons add the cells of their spans."""
    ship(edges.sparkSession)
    a, _, c, _, e, f = transform

    def walk(batches):
        for pdf in batches:
            out: set[tuple[int, int]] = set()
            for x1, y1, x2, y2 in pdf[["x1", "y1", "x2", "y2"]].itertuples(index=False):
                u1, v1, u2, v2 = (x1 - c) / a, (y1 - f) / e, (x2 - c) / a, (y2 - f) / e
                lo, hi = sorted((u1, u2))
                bottom, top = sorted((v1, v2))
                cuts = [0.0, 1.0]
                if u1 != u2:
                    cuts += [(k - u1) / (u2 - u1) for k in range(int(np.ceil(max(lo, 0))), int(np.floor(min(hi, width))) + 1)]
                if v1 != v2:
                    cuts += [(k - v1) / (v2 - v1) for k in range(int(np.ceil(max(bottom, 0))), int(np.floor(min(top, height))) + 1)]
                t = np.unique(np.clip(cuts, 0.0, 1.0))
                mid = (t[1:] + t[:-1]) / 2 if len(t) > 1 else t
                for q in mid:  # each piece between two grid lines lies in one cell
                    r, k = int(np.floor(v1 + q * (v2 - v1))), int(np.floor(u1 + q * (u2 - u1)))
                    if 0 <= r < height and 0 <= k < width:
                        out.add((r, k))
            yield pd.DataFrame(sorted(out), columns=["row", "col"]).astype("int32")

    return edges.mapInPandas(walk, "row int, col int").distinct()
