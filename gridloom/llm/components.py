"""Connected components of a link table by alternating large-star and small-star steps; nothing reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.session import discard, stored


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    near = e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the least id reachable, for every id in a link between two different ids."""
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = stored(e, "links")
    seen = _state(e)
    while seen[0]:
        before, e = e, stored(_small(_large(e)), "links")
        discard(before)
        now = _state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))


def join_unskewed(rows: DataFrame, facts: DataFrame, on: str | list[str], weight: str) -> DataFrame:
    """rows joined with facts, which are unique by `on` and whose `weight` is the number of rows that have the key.
    Keys of over a thousandth of all rows (fewer than a thousand keys, so the broadcast is bounded) meet theirs where they are."""
    on = [on] if isinstance(on, str) else on
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = facts.where(F.col(weight) * 1000 > total)
    there = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(facts, on)
    return there.unionByName(rest.select(*there.columns))
