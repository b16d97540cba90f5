"""The grid that every band shares, as a driver-side description; cells are rows of a table."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.errors import CrsMismatchError, CrsMissingError, GateError

# Fixed values.
VECTOR_CRS, GRID_CRS, RES_M = 4269, 5070, 30.0
FIXTURE_SIZE, FIXTURE_ORIGIN = 32, (750000.0, 2170000.0)
LIVE_KIND = "nlcd_2021"
NODATA = {"nlcd": 255, "sfha": 255, "zone": 255, "dem": -9999.0, "slope": -9999.0, "twi": -9999.0, "hand": -9999.0, "distance": -1.0, "p": -1.0, "block": 0}


def require_crs(crs: int | None, expected: int) -> int:
    if crs is None:
        raise CrsMissingError("no CRS")
    if int(crs) != expected:
        raise CrsMismatchError(f"CRS {crs} is not {expected}")
    return int(crs)


@dataclass(frozen=True)
class GridSpec:
    """An affine grid: x = c + col * a, y = f + row * e, with e below 0."""

    width: int
    height: int
    transform: tuple[float, float, float, float, float, float]
    crs: int = GRID_CRS
    kind: str = "synthetic"

    @classmethod
    def at(cls, west: float, north: float, width: int, height: int, res: float = RES_M, kind: str = "synthetic") -> GridSpec:
        return cls(width, height, (res, 0.0, west, 0.0, -res, north), kind=kind)

    @classmethod
    def fixture(cls) -> GridSpec:
        return cls.at(*FIXTURE_ORIGIN, FIXTURE_SIZE, FIXTURE_SIZE, kind="fixture")

    def validate(self) -> GridSpec:
        require_crs(self.crs, GRID_CRS)
        a, _, _, _, e, _ = self.transform
        if abs(abs(a) - RES_M) > 1e-6 or abs(abs(e) - RES_M) > 1e-6:
            raise GateError(f"cells are not {RES_M} m")
        if self.width < 2 or self.height < 2:
            raise GateError("the grid is too small")
        return self

    def require_live(self) -> GridSpec:
        if self.width <= FIXTURE_SIZE and self.height <= FIXTURE_SIZE:
            raise GateError("the fixture grid is refused here")
        if self.kind != LIVE_KIND:
            raise GateError(f"kind {self.kind} is not {LIVE_KIND}")
        require_crs(self.crs, GRID_CRS)
        return self

    @property
    def payload(self) -> str:
        return f"{self.crs}|{self.width}|{self.height}|" + ",".join(str(float(x)) for x in self.transform)

    def fingerprint(self) -> str:
        return hashlib.sha256(self.payload.encode("ascii")).hexdigest()

    def bounds(self) -> tuple[float, float, float, float]:
        """West, south, east, north."""
        a, _, c, _, e, f = self.transform
        return c, f + self.height * e, c + self.width * a, f

    def cells(self, spark: SparkSession) -> DataFrame:
        """cell_id, row, col of every cell, without a shuffle."""
        ids = spark.range(self.width * self.height).withColumnRenamed("id", "cell_id")
        return ids.select("cell_id", F.floor(F.col("cell_id") / self.width).cast("int").alias("row"), (F.col("cell_id") % self.width).cast("int").alias("col"))

    def synthetic_band(self, spark: SparkSession, inside: DataFrame | None = None) -> DataFrame:
        """A made-up band; if inside (row, col) is given, nodata beyond it."""
        band = self.cells(spark).withColumn("band", (F.col("row") + F.col("col")) % 101)
        if inside is None:
            return band
        known = inside.select("row", "col").distinct().withColumn("_in", F.lit(True))
        return band.join(known, ["row", "col"], "left").withColumn("band", F.when(F.col("_in"), F.col("band")).otherwise(NODATA["nlcd"])).drop("_in")


def fingerprint_column(crs, width, height, transform) -> F.Column:
    """The fingerprint of grids held in a table."""
    parts = F.array_join(F.transform(transform, lambda x: x.cast("string")), ",")
    return F.sha2(F.concat_ws("|", crs.cast("string"), width.cast("string"), height.cast("string"), parts), 256)


def require_same_grid(*prints: str) -> None:
    if len(set(prints)) > 1:
        raise GateError("grids differ between stages")


def snap_bounds(minx, miny, maxx, maxy, res: float = RES_M, pad: int = 1):
    """Columns of bounds moved outward to whole cells and padded: west, south, east, north, width, height."""
    down = lambda x: F.floor(x / res) * res - pad * res
    up = lambda x: F.ceil(x / res) * res + pad * res
    west, south, east, north = down(minx), down(miny), up(maxx), up(maxy)
    return west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"), F.round((east - west) / res).cast("int").alias("width"), F.round((north - south) / res).cast("int").alias("height")


def tiles(bounds: DataFrame, tile_px: int, res: float = RES_M) -> DataFrame:
    """Tiles of windows (west, south, east, north, width, height), row by row from the north-west; the last ones are what remains."""
    starts = lambda n: F.sequence(F.lit(0), F.col(n) - 1, F.lit(tile_px))
    t = bounds.withColumn("row0", F.explode(starts("height"))).withColumn("col0", F.explode(starts("width")))
    w, h = F.least(F.lit(tile_px), F.col("width") - F.col("col0")), F.least(F.lit(tile_px), F.col("height") - F.col("row0"))
    keep = [c for c in bounds.columns if c not in ("west", "south", "east", "north", "width", "height")]
    west, north = F.col("west") + F.col("col0") * res, F.col("north") - F.col("row0") * res
    return t.select(*keep, "row0", "col0", west.alias("tile_west"), north.alias("tile_north"), (west + w * res).alias("tile_east"), (north - h * res).alias("tile_south"), w.alias("tile_w"), h.alias("tile_h"))


def mosaic(tile_cells: DataFrame, order: str = "tile", band: str = "band", nodata: int = 255) -> DataFrame:
    """Cells of overlapping tiles, the first tile with a value wins; 0 is a valid value, nodata is null."""
    ok = tile_cells.where(F.col(band).isNotNull() & (F.col(band) != nodata))
    return ok.groupBy("row", "col").agg(F.min_by(band, order).alias(band))


def crop(cells: DataFrame, inside: DataFrame) -> DataFrame:
    """Cells in a mask, renumbered from its own north-west corner; an empty result is refused."""
    kept = cells.join(inside.select("row", "col").distinct(), ["row", "col"], "left_semi")
    corner = kept.agg(F.min("row").alias("r0"), F.min("col").alias("c0")).first()
    if corner.r0 is None:
        raise GateError("the polygon does not meet the grid")
    return kept.withColumn("row", F.col("row") - corner.r0).withColumn("col", F.col("col") - corner.c0)
