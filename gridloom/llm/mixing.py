"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source has the same expected number of copies, target / size of the source. The whole copies are
certain; the fraction is a probability, and rounding is dependent: going through a source's documents by size, the open
one meets the next, and mass moves between the two at random (so that each keeps its expectation) until one is whole.
Neighbours have nearly equal sizes, so the words taken stay near the target. Leaves of documents run side by side; each
leaves at most one open document per source, and these meet in a reduction tree of small groups until one is left, which
a last draw rounds.

Draws are hashes of the seed and the document, so reruns agree whatever the partitioning.

Defined results: a null or wordless text has size 0; a source of size 0 has target 0 and takes nothing; a null source is a
source of its own, ranked last; rows with equal ids are separate documents; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.llm import arrays as A
from gridloom.llm.components import join_unskewed
from gridloom.session import partitions, ship, stored

#: Documents of a leaf, and leaves that meet in one group of the tree. Results hang on these and the rows, not on the cluster.
LEAF_ROWS, FAN_IN = 16384, 16


def ranked(sources: DataFrame, n: int) -> DataFrame:
    """Sources with `rank`, from 0, by code point and null last. Ranges of sources are numbered side by side and then moved up by what comes before."""
    order = [F.col("source").isNull(), F.encode("source", "UTF-8")]
    parts = sources.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = stored(parts.withColumn("at", F.monotonically_increasing_id()), "sources")
    part, nth = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.part, r.c) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("c")).collect())  # a row for each of n parts
    before, moved = 0, []
    for k, c in sizes:
        moved.append((k, before))
        before += c
    offsets = sources.sparkSession.createDataFrame(moved, "part long, before long")
    return rows.withColumn("part", part).join(F.broadcast(offsets), "part").select("source", "source_size", "rows", (nth + F.col("before")).alias("rank"))


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float, n: int) -> DataFrame:
    """source, source_size, rows, target. sources: one row each, with source_size and rows. Excess above a source's cap goes to the
    others by weight, again and again until none is above: each turn is one sum over the sources, and only adds sources to the full ones."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = stored(ranked(sources, n).withColumn("w", w).withColumn("cap", F.col("source_size") * float(most)), "caps")
    budget = (s.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, n_full = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("w") * level
        got = s.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap"))).alias("given"), F.sum(F.when(~full, F.col("w"))).alias("open")).first()
        if got.n == n_full or not got.open:
            break
        n_full, level = got.n, (budget - (got.given or 0.0)) / got.open
    return s.select("source", "source_size", "rows", F.least(F.col("cap"), F.col("w") * F.lit(level)).alias("target"))


def draw(seed: int, doc: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (A.mix_with(A.mix(doc.view(np.uint64) + np.uint64(seed)), other.view(np.uint64)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def meet(p: float, q: float, u: float) -> tuple[float, float]:
    """Move mass between two probabilities strictly between 0 and 1 until one is whole; both keep their expectation."""
    if p + q < 1:
        return (p + q, 0.0) if u * (p + q) < p else (0.0, p + q)
    if p + q == 1:
        return (1.0, 0.0) if u < p else (0.0, 1.0)
    rest = p + q - 1
    return (1.0, rest) if u * (2 - p - q) < 1 - q else (rest, 1.0)


SCHEMA = "doc_id long, size long, source string, source_size long, target double, whole long, p double, state int"


def rounding(seed: int):
    """For mapInArrow: rows come sorted by `grp`, source and size. Gives them back settled (state 1; whole counts all copies) or, one at most of a group's source, open (state 0)."""

    def settled(row: tuple, p: float) -> tuple:
        return (*row[:5], row[5] + round(p), 0.0, 1)

    def run(batches):
        left: tuple[tuple, float] | None = None
        at = None
        for b in batches:
            out = []
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "size", "source", "source_size", "target", "whole", "p")]
            groups = b.column(b.schema.get_field_index("grp")).to_pylist()
            ids = np.array([-1 if x is None else x for x in cols[0]], np.int64)
            u = draw(seed, ids, np.array(cols[1], np.int64)).tolist()
            for i, (*row, p) in enumerate(zip(*cols)):
                if at != (groups[i], row[2]):
                    if left:
                        out.append((*left[0], left[1], 0))
                    left, at = None, (groups[i], row[2])
                if whole(p):
                    out.append(settled(row, p))
                elif left is None:
                    left = (row, p)
                else:
                    pair, left = (left, (row, p)), None
                    for (r, _), x in zip(pair, meet(pair[0][1], p, u[i])):
                        if whole(x):
                            out.append(settled(r, x))
                        else:
                            left = (r, x)
            if out:
                yield batch(out)
        if left:
            yield batch([(*left[0], left[1], 0)])

    return run


def whole(p: float) -> bool:
    return not 1e-9 < p < 1 - 1e-9


TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int32()]
NAMES = ["doc_id", "size", "source", "source_size", "target", "whole", "p", "state"]


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)


def mix_sources(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target (its source's words), copies and taken (words, repeats counted) of every row."""
    spark = ship(df.sparkSession)
    n = partitions(spark)
    docs = stored(df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.regexp_count(text_col, F.lit("[^ \\x09-\\x0D]+")), F.lit(0)).cast("long").alias("size"), F.col(source_col).alias("source")), "sizes")
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    key = lambda df: df.withColumn("no_source", F.col("source").isNull()).withColumn("key", F.coalesce("source", F.lit("")))
    targets = key(stored(source_targets(sums, weights, share, most, n), "targets")).drop("source")
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rows = join_unskewed(key(docs), targets, ["no_source", "key"], "rows").select("doc_id", "size", "source", "source_size", "target", copies.alias("c"))
    rows = rows.select("doc_id", "size", "source", "source_size", "target", F.floor("c").alias("whole"), (F.col("c") - F.floor("c")).alias("p"))
    leaves = FAN_IN ** max(0, math.ceil(math.log(max(1, docs.count()) / LEAF_ROWS, FAN_IN)))
    done: DataFrame | None = None
    while True:
        rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(leaves)).cast("int"))
        dealt = rows.repartition(min(n, leaves), "grp") if leaves > 1 else rows.repartition(n, "source")
        out = stored(dealt.sortWithinPartitions("grp", "source", F.desc("size"), "doc_id").mapInArrow(rounding(seed + leaves), SCHEMA), f"rounded-{leaves}")
        part = out.where("state = 1")
        done = part if done is None else done.union(part)
        rows = out.where("state = 0").drop("state")
        if leaves == 1:
            break
        leaves //= FAN_IN
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 53)) / float(1 << 53)
    done = done.drop("state").union(rows.drop("grp").withColumn("whole", F.col("whole") + (u < F.col("p")).cast("long")))
    return done.select("doc_id", "size", "source", "source_size", "target", F.col("whole").alias("copies"), (F.col("size") * F.col("whole")).alias("taken"))
