"""Exact top-k inner products by norm order and partial sums.

Vectors are turned by the right singular vectors of (the second moment of) all vectors, so that leading coordinates hold
most of every inner product. Candidates are taken by descending length, in ranges that grow sixteenfold: what a range finds
raises each query's k-th score, and the next range begins with it. Within a range, each task goes through its candidates by
descending length in steps: a candidate is pruned if its length times the query's stays below the k-th score, before any
product is taken, and then if its partial sum plus the product of the residual lengths (Cauchy-Schwarz) does; what is left is
scored exactly in whole numbers and raises the k-th score for the next step. Bounds carry a margin above the rounding of the
rotation, so pruning never loses a neighbour, ties included.

Queries are a stated set of any size: they lie in the shared folder, ordered by the length that a candidate needs to matter
to them, and each task reads them block by block until its candidates are too short for the rest. Neither the driver, nor a
broadcast, nor the plan grows with them; the plan grows with the logarithm of the number of vectors.

Defined results: vectors that are null or hold null or non-finite components take no part; a shorter vector counts as padded
with zeros, an empty one as all zeros; rows of a query's own id are no candidates of it, and repeated rows count as often as
they come; with fewer candidates than k all are given; ties go to the smaller id; other columns are ignored. Whole numbers
that do not fit into 62 bits, and scores that do not fit into 63, are refused with an error: nothing overflows silently.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.llm.files import file_system
from gridloom.session import partitions, shared_path, ship, stored

QUERY_BLOCK = 2048
#: Candidates of the first range, and the growth of the ranges after it.
HEAD, GROWTH = 4096, 16
#: Numbers of a block of candidates in memory, queries and candidates of a step, and coordinates that are turned at most.
CHUNK, ROWS, STEP, TURNED = 1 << 21, 64, 1024, 256
MOST = float(1 << 62)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, x: floor(scale * component) of the rows that take part, as doubles (exact), and their length."""
    x = F.col(f"`{vector_col}`")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = df.where(F.col(f"`{id_col}`").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(x, lambda v: v.cast("double") * F.lit(float(scale))).alias("x"))
    too_big = F.raise_error(F.lit("a vector's component does not fit into 62 bits as a whole number")).cast("double")
    rows = rows.withColumn("x", F.transform("x", lambda v: F.when(F.abs(v) >= MOST, too_big).when(F.abs(v) < float(1 << 53), F.floor(v).cast("double")).otherwise(v)))
    return rows.withColumn("length", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)))


def matrix(col, dim: int) -> np.ndarray:
    """Rows of an array column, padded with zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(col.flatten(), np.float64)
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors' first coordinates, from the sum of their outer products (dim x dim numbers a task)."""

    def moment(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            m = matrix(b.column(0), int(max(dim, b.column(0).value_lengths().to_numpy(zero_copy_only=False).max(initial=0))))[:, :dim]
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    part = vectors.select("x").mapInArrow(moment, "i int, row array<double>")
    sums = part.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((dim, dim))
    for r in sums:
        total[r.i, r.j] = r.v
    return np.linalg.eigh(total)[1][:, ::-1]


def parts_of(x: np.ndarray, turn: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates of turned vectors, and the lengths of the rest (coordinates that are not turned included)."""
    r = len(turn)
    turned = x[:, :r] @ turn
    rest = np.einsum("ij,ij->i", turned[:, lead:], turned[:, lead:]) + np.einsum("ij,ij->i", x[:, r:], x[:, r:])
    return np.ascontiguousarray(turned[:, :lead]), np.sqrt(rest)


def exact(q: np.ndarray, c: np.ndarray, small: bool) -> np.ndarray:
    """Inner products of pairs of rows as whole numbers: in doubles where these are exact, else in Python's."""
    if small:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    out = [sum(int(a) * int(b) for a, b in zip(x, y)) for x, y in zip(q.tolist(), c.tolist())]
    if any(abs(s) >= 1 << 63 for s in out):
        raise OverflowError("an inner product does not fit into 63 bits")
    return np.array(out, np.int64)


class Candidates:
    """A block of candidates by descending length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, lead: int):
        length = np.sqrt(np.einsum("ij,ij->i", x, x))
        order = np.lexsort((ids, -length))
        self.ids, self.x, self.length = ids[order], x[order], length[order]
        self.lead, self.rest = parts_of(self.x, turn, lead)

    def search(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, turn: np.ndarray, k: int, lead: int):
        """Arrays (query, candidate, score): the k best of each query, of those not below its floor."""
        q_length = np.sqrt(np.einsum("ij,ij->i", q, q))
        q_lead, q_rest = parts_of(q, turn, lead)
        slack = 1e-9 * (1 + self.length[0]) * (1 + q_length) + 1e-6
        found = []
        reach = np.divide(floor - slack, q_length, out=np.where(floor - slack > 0, np.inf, -np.inf), where=q_length > 0)
        ahead = np.searchsorted(-self.length, -reach, "right")  # candidates long enough
        order = np.argsort(-ahead, kind="stable")
        for s in range(0, len(order), ROWS):
            i = order[s : s + ROWS]
            if not ahead[i[0]]:
                break
            low = floor[i].copy()
            rows, cols, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for a in range(0, int(ahead[i[0]]), STEP):
                b = min(a + STEP, int(ahead[i[0]]))
                sure = (low - slack[i])[:, None]
                ok = self.length[a:b][None, :] * q_length[i][:, None] >= sure
                if not ok.any():
                    break
                ok &= q_lead[i] @ self.lead[a:b].T + q_rest[i][:, None] * self.rest[a:b][None, :] >= sure
                ok &= q_ids[i][:, None] != self.ids[a:b][None, :]
                u, v = np.nonzero(ok)
                if not len(u):
                    continue
                small = bool(self.length[a] * q_length[i].max() < 1 << 51)
                v = v + a
                if small and len(u) * 8 > ok.size:
                    score = (q[i] @ self.x[a:b].T)[u, v - a].astype(np.int64)
                else:
                    score = exact(q[i[u]], self.x[v], small)
                rows, cols, scores = np.concatenate((rows, u)), np.concatenate((cols, v)), np.concatenate((scores, score))
                best = np.lexsort((self.ids[cols], -scores, rows))
                rows, cols, scores = rows[best], cols[best], scores[best]
                first = np.searchsorted(rows, rows)
                nth = np.arange(len(rows)) - first
                keep = nth < k
                rows, cols, scores, nth = rows[keep], cols[keep], scores[keep], nth[keep]
                last = nth == k - 1
                low[rows[last]] = np.maximum(low[rows[last]], scores[last].astype(float))
            keep = scores >= low[rows] - slack[i[rows]]
            found.append((q_ids[i[rows[keep]]], self.ids[cols[keep]], scores[keep]))
        return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3


def query_blocks(path: str, dim: int, longest: float, block: int):
    """(ids, vectors, floors) of the queries to which a candidate of that length could matter."""
    fs, base = file_system(path)
    files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".parquet"))
    for name in files:
        with fs.open_input_file(name) as source:
            file = pq.ParquetFile(source)
            for batch in file.iter_batches(block, columns=["vec_id", "x", "floor", "need"]):
                need = batch.column("need").to_numpy(zero_copy_only=False)
                n = int(np.searchsorted(need, longest * (1 + 1e-9), "right"))
                if n:
                    yield batch.column("vec_id").to_numpy(zero_copy_only=False)[:n], matrix(batch.column("x"), dim)[:n], batch.column("floor").to_numpy(zero_copy_only=False)[:n]
                if n < len(need):
                    break  # the rest needs longer ones


def length_bounds(vectors: DataFrame, n: int) -> list[float]:
    """Descending lengths at which ranges end; ranges grow GROWTH-fold."""
    shares, size = [], HEAD
    while size * 4 < n:
        shares.append(1 - size / n)
        size *= GROWTH
    found = vectors.agg(F.percentile_approx("length", F.array(*map(F.lit, shares)), 10_000)).first()[0] if shares else []
    return sorted({float(x) for x in found}, reverse=True)


def top_inner_products(df: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query (rows for which is_query(id column) holds)."""
    spark = ship(df.sparkSession)
    n = partitions(spark)
    vectors = stored(whole_vectors(df, id_col, vector_col, scale), "vectors")
    asked = is_query(F.col("vec_id"))
    rows, n_queries, dim = vectors.agg(F.count("*"), F.count(F.when(asked, 1)), F.max(F.size("x"))).first()
    if not rows or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(dim, 1)
    turn = rotation(vectors, min(dim, TURNED))
    lead = max(1, min(dim, TURNED) // 4)
    queries = stored(vectors.where(asked), "queries")
    bounds = [float("inf"), *length_bounds(vectors, rows), -1.0]
    best: DataFrame | None = None
    for high, low in zip(bounds, bounds[1:]):
        floors = spark.createDataFrame([], "query_id long, floor double") if best is None else best.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
        ready = queries.join(floors, F.col("vec_id") == F.col("query_id"), "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        ready = ready.withColumn("need", F.when(F.col("length") > 0, F.col("floor") / F.col("length")).when(F.col("floor") > 0, float("inf")).otherwise(float("-inf")))
        path = shared_path(spark, "queries")
        ready.select("vec_id", "x", "floor", "need").repartitionByRange(1 + n_queries // 65536, "need").sortWithinPartitions("need").write.option("parquet.block.size", 4 << 20).parquet(path)
        found = vectors.where((F.col("length") > low) & (F.col("length") <= high)).repartitionByRange(n, F.desc("length")).sortWithinPartitions(F.desc("length")).select("vec_id", "x").mapInArrow(seek(path, dim, turn, k, lead, query_block), "query_id long, vec_id long, score long")
        if best is not None:
            found = found.union(best.select("query_id", "vec_id", "score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = stored(found.withColumn("rank", rank).where(F.col("rank") <= k), "best")
    return best.select("query_id", "rank", "vec_id", "score")


def seek(path: str, dim: int, turn: np.ndarray, k: int, lead: int, query_block: int):
    """For mapInArrow over (vec_id, x): what Candidates.search() finds for the queries below path."""
    most = max(1, CHUNK // dim)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def settle():
            table = pa.Table.from_batches(held)
            held.clear()
            for at in range(0, table.num_rows, most):
                t = table.slice(at, most)
                block = Candidates(t["vec_id"].to_numpy(), matrix(t["x"], dim), turn, lead)
                for ids, q, floor in query_blocks(path, dim, float(block.length[0]), query_block):
                    who, what, score = block.search(ids, q, floor, turn, k, lead)
                    if len(who):
                        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(what), pa.array(score)], names=["query_id", "vec_id", "score"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                if sum(x.num_rows for x in held) >= most:
                    yield from settle()
        if held:
            yield from settle()

    return run
