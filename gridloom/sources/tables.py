"""Cell tables, facility files and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.errors import GateError
from gridloom.functions.claims import BANNED_NAMES, require_clean
from gridloom.plans.grid import GridSpec

# Fixed values.
REPORTS = {"0": "stage0_report.json", "A": "stage_a_report.json", "B": "stage_b_report.json", "C": "stage_c_report.json", "D": "stage_d_report.json"}
FACILITIES = "key string, name string, lat double, lon double, state string, huc string, year int, on_site_release_lb double, n_chem int"
BAND_ROWS = 1024


def write_cells(cells: DataFrame, path: str, grid: GridSpec) -> None:
    """Cells by bands of rows, so that readers of a row range skip the rest."""
    bad = cells.where((F.col("row") < 0) | (F.col("row") >= grid.height) | (F.col("col") < 0) | (F.col("col") >= grid.width))
    if not bad.isEmpty():
        raise GateError("cells lie beyond the grid")
    cells.withColumn("row_band", F.floor(F.col("row") / BAND_ROWS).cast("int")).repartition("row_band").sortWithinPartitions("row", "col").write.mode("overwrite").partitionBy("row_band").parquet(path)


def read_cells(spark: SparkSession, path: str, rows: tuple[int, int] | None = None) -> DataFrame:
    """Cells, of the rows from..to if given (other bands are pruned)."""
    df = spark.read.parquet(path)
    if rows:
        df = df.where(F.col("row_band").between(rows[0] // BAND_ROWS, rows[1] // BAND_ROWS) & F.col("row").between(*rows))
    return df.drop("row_band")


def read_releases(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Raw release rows as strings; `ordinal` is the order within the file. JSON rows may differ in their keys."""
    df = spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.option("primitivesAsString", True).option("multiLine", True).json(path)
    return df.withColumn("ordinal", F.monotonically_increasing_id())


def read_facilities(spark: SparkSession, path: str, unit: str) -> DataFrame:
    df = spark.read.option("header", True).schema(FACILITIES).csv(path)
    return df.withColumn("huc", F.coalesce("huc", F.lit(unit)))


def write_csv(rows: DataFrame, path: str) -> None:
    """One file with a header; for results of a few rows."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report(spark: SparkSession, report: dict, folder: str) -> str:
    """A report as text through Spark's writer, after the claim scan over its raw text."""
    text = json.dumps(report, indent=2, default=str, ensure_ascii=False)
    require_clean(text, f"stage {report.get('stage')}", BANNED_NAMES)
    path = f"{folder.rstrip('/')}/{REPORTS[str(report['stage'])]}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
