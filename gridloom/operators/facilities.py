"""Facility tables: rollup of release rows, budgets, ranking and the overlay on a probability band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.errors import GateError
from gridloom.functions.scalar import UNSHADED_X, d1_eligible, parse_float, pmax_note, zone_name
from gridloom.operators.focal import window_stats

# Fixed values.
STATES = ("IN", "IL", "MI")
YEARS = (2023, 2022, 2021)
HEADLINE, RADIUS = 5, 4
ALIASES = {"state": ("5. ST", "ST", "STATE"), "unit": ("UNIT OF MEASURE", "UNIT"), "chemical": ("CHEMICAL", "CHEMICAL NAME"), "onsite": ("ON-SITE RELEASE TOTAL", "ONSITE RELEASE TOTAL"), "offsite": ("OFF-SITE RELEASE TOTAL", "OFFSITE RELEASE TOTAL"), "lat": ("LATITUDE", "LATITUDE83"), "lon": ("LONGITUDE", "LONGITUDE83"), "frs": ("FRS ID", "FRS_ID", "REGISTRY"), "trifd": ("TRIFD", "TRIFID", "TRI FACILITY ID"), "name": ("FACILITY NAME", "PRIMARY_NAME")}


def by_alias(raw: DataFrame, needles: tuple[str, ...]) -> Column:
    """The first of the needles that is a column (whatever its case and spaces), trimmed; empty if there is none."""
    have = {c.upper().strip(): c for c in raw.columns}
    for n in needles:
        if n.upper() in have:
            return F.coalesce(F.trim(F.col("`" + have[n.upper()].replace("`", "``") + "`").cast("string")), F.lit(""))
    return F.lit("")


def parse_releases(raw: DataFrame, order: Column | None = None) -> DataFrame:
    """Raw release rows with any of the known headers: typed columns, flags and `ordinal` (the order of the file)."""
    if not raw.columns:
        raise GateError("the table has no header")
    c = {k: by_alias(raw, v) for k, v in ALIASES.items()}
    t = raw.select((order if order is not None else F.monotonically_increasing_id()).alias("ordinal"), F.upper(c["state"]).alias("state"), F.upper(c["unit"]).alias("unit"), F.upper(c["chemical"]).alias("chemical"), parse_float(c["onsite"]).alias("onsite"), parse_float(c["offsite"]).alias("offsite"), parse_float(c["lat"]).alias("lat"), parse_float(c["lon"]).alias("lon"), c["frs"].alias("frs"), c["trifd"].alias("trifd"), c["name"].alias("name"))
    return t.withColumn("held", F.col("chemical").contains("DIOXIN") | F.col("unit").isin("GRAMS", "G"))


def in_states(releases: DataFrame, states: tuple[str, ...] = STATES) -> DataFrame:
    """Rows of the states, and those without one."""
    return releases.where((F.col("state") == "") | F.col("state").isin(*states))


def rollup(releases: DataFrame, year: int, states: tuple[str, ...] = STATES) -> DataFrame:
    """One row per facility; the first row names it, of rows with equal ordinals the least by all that names it. Grams are held: they count as a chemical of 0 pounds."""
    rows = in_states(releases, states).where("lat is not null and lon is not null")
    key = F.coalesce(F.nullif("frs", F.lit("")), F.nullif("trifd", F.lit("")), F.format_string("%.5f,%.5f", "lat", "lon"))
    lb = F.when(F.col("held"), F.lit(0.0)).otherwise(F.coalesce("onsite", F.lit(0.0)))
    about = F.struct("frs", "trifd", "name", "lat", "lon", "state")
    first = F.min_by(about, F.struct("ordinal", *(f"{c}" for c in ("frs", "trifd", "name", "lat", "lon", "state")))).alias("f")  # equal ordinals: the least row
    g = rows.withColumn("key", key).groupBy("key").agg(first, F.sum(lb).alias("on_site_release_lb"), F.count("*").alias("n_chem"))
    return g.select("key", "f.*", "on_site_release_lb", "n_chem", F.lit(year).alias("year"))


def budget(releases: DataFrame, states: tuple[str, ...] = STATES) -> DataFrame:
    """Counts of one pass over all rows. Held and off-site rows count before those without coordinates go."""
    ok = (F.col("state") == "") | F.col("state").isin(*states)
    return releases.agg(
        F.count("*").alias("n_rows"),
        F.count_if(ok).alias("n_in_states"),
        F.count_if(~ok).alias("n_dropped_other_state"),
        F.count_if(ok & F.col("held")).alias("n_held"),
        F.count_if(ok & (F.coalesce("offsite", F.lit(0.0)) != 0)).alias("n_off_site"),
        F.count_if(ok & (F.col("lat").isNull() | F.col("lon").isNull())).alias("n_missing_xy"),
    )


def first_year(by_year, years: tuple[int, ...] = YEARS):
    """(year, facilities) of the first year that has any: by_year(year) gives the clipped facilities."""
    for y in years:
        got = by_year(y)
        if not got.isEmpty():
            return y, got
    raise GateError("no year has facilities inside")


def refuse_names(facilities: DataFrame, banned: tuple[str, ...], name: str = "name") -> DataFrame:
    for b in banned:
        if not facilities.where(F.upper(name).contains(b.upper())).isEmpty():
            raise GateError("a banned name is among the facilities")
    return facilities


def overlay(points: DataFrame, p_cells: DataFrame, zones: DataFrame, keys: list[str], radius: int = RADIUS) -> DataFrame:
    """Points (row, col) with zone, window statistics of p, the note on the highest cell, and whether they qualify.

    zones: row, col, zone, dist_flowline, dist_waterbody. Points beyond the grid have an empty window and the zone `off_grid`.
    """
    out = window_stats(points, p_cells, "p", keys, radius)
    out = out.join(zones.select("row", "col", "zone"), ["row", "col"], "left")
    top = zones.select(F.col("row").alias("max_row"), F.col("col").alias("max_col"), F.col("zone").alias("_z"), F.col("dist_flowline").alias("_f"), F.col("dist_waterbody").alias("_w"))
    out = out.join(top, ["max_row", "max_col"], "left")
    out = out.withColumn("p_max_note", pmax_note(F.col("row"), F.col("col"), F.col("max_row"), F.col("max_col"), F.col("_z"), F.col("_f"), F.col("_w")))
    return out.withColumn("zone_class", zone_name(F.col("zone"))).withColumn("d1", d1_eligible(F.col("zone"), F.col("p_max"))).drop("_z", "_f", "_w")


def headline(d1: DataFrame, ordinal: str, n: int = HEADLINE) -> DataFrame:
    """The n highest by (p_max, pounds), input order on ties; planned as a top-k, not a sort."""
    return d1.where("p_max is not null and p_mean is not null").orderBy(F.desc("p_max"), F.desc("on_site_release_lb"), F.asc(ordinal)).limit(n)


def require_headline(d1: DataFrame, top: DataFrame, n: int = HEADLINE) -> DataFrame:
    if d1.count() >= n and top.count() != n:
        raise GateError(f"the headline needs {n} scored rows")
    return top


def not_d1_by_zone(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("d1")).groupBy("zone_class").agg(F.count("*").alias("n"))


__all__ = ["UNSHADED_X", "budget", "by_alias", "first_year", "headline", "in_states", "not_d1_by_zone", "overlay", "parse_releases", "refuse_names", "require_headline", "rollup"]
