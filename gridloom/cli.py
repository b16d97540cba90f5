"""Command line: one subcommand a stage. Inputs are paths that Spark reads; reports go to the output folder, and a line to the screen.

    python -m gridloom.cli 0 --unit unit.geojson --out out
    python -m gridloom.cli D --unit unit.geojson --grid grid.json --out out --releases releases.csv --year 2023
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession, functions as F

from gridloom.errors import GateError
from gridloom.operators import facilities
from gridloom.plans import laws, stages
from gridloom.plans.grid import GridSpec
from gridloom.session import ship
from gridloom.sources import geojson, tables


def grid_of(spark: SparkSession, path: str | None) -> GridSpec:
    """A grid described by JSON: width, height, transform, crs, kind; the fixture without one."""
    if path is None:
        return GridSpec.fixture()
    about = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return GridSpec(about["width"], about["height"], tuple(about["transform"]), about.get("crs", 5070), about.get("kind", "synthetic"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    stage = p.add_subparsers(dest="stage", required=True)
    extra = {"0": (), "A": ("zones",), "B": ("elevation", "flowlines", "waterbodies", "areas"), "C": ("blocks",), "D": ("releases",)}
    for name in laws.ORDER:
        s = stage.add_parser(name)
        s.add_argument("--unit", required=True, help="GeoJSON polygons of the unit")
        s.add_argument("--out", required=True)
        s.add_argument("--grid", help="JSON description of the grid")
        s.add_argument("--wkid", type=int, help="CRS of the unit, where the file names none")
        for k in extra[name]:
            s.add_argument(f"--{k}", required=True)
        if name == "A":
            s.add_argument("--samples", help="CSV of key, lon, lat, zone_class that the bands must show")
        if name == "C":
            s.add_argument("--rounds", type=int, help="boosting rounds")
        if name == "D":
            s.add_argument("--year", type=int, default=facilities.YEARS[0])
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The report of a stage."""
    grid, out = grid_of(spark, args.grid), args.out.rstrip("/")
    if args.stage == "0":
        return stages.run_stage_0(spark, args.unit, grid, out, args.wkid)
    if args.stage == "A":
        samples = spark.read.option("header", True).schema("key string, lon double, lat double, zone_class string").csv(args.samples) if args.samples else None
        return stages.run_stage_a(spark, args.unit, grid, geojson.read_features(spark, args.zones), out, samples, args.wkid)
    polygons, unit = geojson.load_unit(spark, args.unit, args.wkid)
    before = {s: tables.read_report(spark, f"{out}/{tables.REPORTS[s]}") for s in laws.ORDER[1 : laws.ORDER.index(args.stage)]}
    if args.stage == "B":
        layers = [geojson.read_features(spark, p) for p in (args.flowlines, args.waterbodies, args.areas)]
        return stages.run_stage_b(spark, grid, unit, spark.read.parquet(args.elevation).select("row", "col", "z"), *layers, before["A"], f"{out}/zones", out, (args.elevation, args.flowlines, args.waterbodies, args.areas))
    if args.stage == "C":
        model = {"maxIter": args.rounds} if args.rounds else {}
        return stages.run_stage_c(spark, grid, unit, geojson.read_features(spark, args.blocks), before["A"], before["B"], f"{out}/zones", f"{out}/bands", out, **model)
    raw = tables.read_releases(spark, args.releases, "json" if args.releases.endswith(".json") else "csv")
    sites = facilities.rollup(facilities.parse_releases(raw, F.col("ordinal")), args.year)
    return stages.run_stage_d(spark, grid, unit, polygons, sites, args.year, before["C"], f"{out}/zones", f"{out}/bands", f"{out}/p", out)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        report = run(ship(SparkSession.builder.appName("gridloom").getOrCreate()), args)
    except GateError as e:
        print(f"stage {args.stage} refused: {e}", file=sys.stderr)
        return 1
    height, width = report["grid_shape"]
    print(f"stage {report['stage']} gate={report['gate']} unit={report['huc8']} grid={report['grid_kind']} {width}x{height}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
