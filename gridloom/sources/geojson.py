"""GeoJSON polygons and features."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.errors import EmptyUnitError
from gridloom.plans.grid import VECTOR_CRS, require_crs
from gridloom.plans.laws import require_unit

# Names of properties, the first that is set counts.
CODE = ("huc8", "HUC8", "huc", "HUC")
POINTS = "array<array<double>>"


def crs_code(name: str | None, wkid: object = None) -> int | None:
    """The code in a CRS name (the number after the last colon), or the wkid."""
    m = re.search(r"(?:^|:)(\d+)\s*$", name or "")
    if m:
        return int(m[1])
    try:
        return int(str(wkid))
    except ValueError:
        return None


def first_of(props: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.element_at(props, n)), F.lit("")) for n in names])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, props (map of strings), kind, rings (lines and polygons alike; points and empty geometries have none) of a FeatureCollection."""
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    f = doc.select(F.posexplode("features").alias("ordinal", "f")).select("ordinal", F.col("f.properties").alias("props"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    one, two, three = (F.from_json("c", t) for t in (POINTS, f"array<{POINTS}>", f"array<array<{POINTS}>>"))
    rings = F.when(F.col("kind") == "LineString", F.array(one)).when(F.col("kind").isin("Polygon", "MultiLineString"), two).when(F.col("kind") == "MultiPolygon", F.flatten(three))
    points = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return f.select("ordinal", "props", "kind", F.coalesce(points, F.array().cast("array<array<struct<x:double,y:double>>>")).alias("rings"))


def read_crs(spark: SparkSession, path: str) -> int | None:
    doc = spark.read.schema("crs struct<properties:map<string,string>>").option("multiLine", True).json(path).first()
    props = (doc.crs.properties if doc and doc.crs else None) or {}
    return crs_code(props.get("name"), props.get("wkid"))


def load_unit(spark: SparkSession, path: str, wkid: int | None = None, expected: str | None = None) -> tuple[DataFrame, dict]:
    """The polygons of a unit and its description, after the gates on CRS, code, states and area."""
    crs = read_crs(spark, path)
    require_crs(crs if crs is not None else wkid, VECTOR_CRS)
    features = read_features(spark, path).where(F.size("rings") > 0)
    rows = features.select("ordinal", first_of(F.col("props"), CODE).alias("code"), first_of(F.col("props"), ("name", "NAME")).alias("name"), first_of(F.col("props"), ("states", "STATES")).alias("states"), first_of(F.col("props"), ("areasqkm", "AREASQKM")).alias("area"))
    got = rows.agg(F.count("*").alias("n"), F.min_by("code", F.when(F.col("code").isNotNull(), F.col("ordinal"))).alias("code"), F.min_by(F.struct("name", "states", "area"), "ordinal").alias("first")).first()
    if not got.n:
        raise EmptyUnitError(f"no polygons in {path}")
    area = None if got.first.area is None else float(got.first.area)
    code = require_unit(got.code, got.first.states or "", area, **({"expected": expected} if expected else {}))
    return features, {"huc8": code, "name": got.first.name or "", "states": got.first.states or "", "areasqkm": area, "crs": VECTOR_CRS, "n_features": got.n}
