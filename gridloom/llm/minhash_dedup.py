"""MinHash near-dedup by an inverted join on signature coordinates.

Every document posts its signature's (coordinate, value) pairs. Two documents alike enough share at least `matches` of
the coordinates (the threshold lies SIGMAS standard deviations below the mean at the similarity asked for), so each pair
has a common value among either one's `coordinates - matches + 1` rarest: only those prefixes are posted, and documents
with fewer than `matches` shared values are skipped. Collisions are then counted over whole signatures, and pairs that
reach `matches` are confirmed on the full shingle sets. Before a pair becomes a row, parity bitmaps of the two sets are held
against each other: they differ in at most as many bits as the sets do in shingles, so this turns away no pair that is alike.

Equal sets collapse to one representative, which has a number of its own, before anything else. Links are wanted for
components, so pairs are not all listed: first each document meets the least member of each of its postings; then, in
postings that still hold several components, members of different components meet, and a forest of the pairs that could be
links is confirmed; if any of these is none, all pairs of the components then left are confirmed. After that no candidate
pair between two components is left untested. Long postings are cut into blocks of members whose pairs are dealt out as cells, and the
number of buckets follows from the members counted, so a task's memory is bounded whatever the size of a posting. Sets
that are compared travel in parts of bounded size, once for each cell of a representative and not for each pair.

Defined results: a text with fewer words than a shingle is one shingle; one without words, or a null, has none and is
linked with nothing; each row is a document of its own, also where ids are equal or null, and `component_id` is the least
id that is not null among the rows it can reach (null if there is none); `kept` says whether that is the row's own id,
`stays` is true for exactly one row of each component: that of the least id, and of the first row among equal ids; other
columns are ignored unless named in `carry` (one named like a result comes out with `_in` behind its name).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gridloom.llm import arrays as A
from gridloom.llm.columns import private, public
from gridloom.llm.components import components, join_unskewed
from gridloom.session import partitions, ship, stored

SIGMAS = 4.7
#: Many coordinates make the threshold sharp: the fewer a pair needs beyond those that a shared passage gives it, the more such pairs are met.
COORDINATES = 192
#: Least members of postings that a document meets first, those it shares most with.
HUBS = 3
#: Members of a posting that meet in one cell, and members in one bucket of cells.
CELL_MEMBERS, BUCKET_MEMBERS = 8192, 100_000
#: Shingles of a set that travel in one row, and bits of a parity bitmap.
PART, PARITY_BITS = 512, 2048
#: Bits of the filter that keeps most documents without a candidate from being shuffled: 8 for each wanted document, within these bounds. The joins after it are exact.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: Signatures travel with 8 bits a coordinate, so an early common token may be a mistaken one; that so many come before all true ones does not happen (1 in 10**8).
TIMES = 6


def enough_matches(coordinates: int, similarity: float) -> int:
    return max(1, math.floor(coordinates * similarity - SIGMAS * math.sqrt(coordinates * similarity * (1 - similarity))))


def shingle_runs(texts: list[bytes], words: int):
    """Sorted distinct shingle hashes of each text: (hashes of all texts, number of each text)."""
    _, _, _, first, count, tokens = A.words_of([t.translate(A.LOWER) for t in texts])
    size = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    roll = A.Rolling(tokens)
    at = A.spread(first, size)
    width = np.repeat(np.minimum(count, words), size)
    h = A.mix(roll.ranges(at, at + width) + width.astype(np.uint64))
    ends = np.cumsum(size)
    start = ends - size
    for s, e in zip(start.tolist(), ends.tolist()):
        h[s:e].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[start[size > 0]] = True
    total = np.concatenate(([0], np.cumsum(new)))
    return h[new], total[ends] - total[start]


def fingerprints(h: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums of the hashes of each set."""
    end = np.cumsum(n)
    sums = [np.concatenate(([np.uint64(0)], np.cumsum(A.mix(h ^ np.uint64(s))))) for s in (3, 5)]
    return [(c[end] - c[end - n]).view(np.int64) for c in sums]


def text_chunks(column: pa.Array):
    """(first, end, texts) of about CHUNK bytes of a column: no more texts are Python's own at once."""
    sizes = pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for i, j in A.chunks(sizes):
        yield i, j, texts_of(column.slice(i, j - i))


def texts_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sketch(h: np.ndarray, n: np.ndarray, coordinates: int) -> np.ndarray:
    """Signatures (uint32) of the texts that have shingles; zeros for others. Each product of a seed serves two coordinates."""
    rng = np.random.default_rng(41)
    seeds = rng.integers(0, 1 << 63, ((coordinates + 1) // 2, 2), dtype=np.uint64)
    sig = np.zeros((len(n), coordinates), np.uint32)
    some = np.flatnonzero(n)
    if len(some):
        start = (np.cumsum(n) - n)[some]
        for j in range(0, coordinates, 2):
            y = (h ^ seeds[j // 2, 0]) * (seeds[j // 2, 1] | np.uint64(1))
            y ^= y >> np.uint64(32)
            y *= np.uint64(0xD6E8FEB86659FD93)
            halves = y.view(np.uint32).reshape(-1, 2)
            for k in range(min(2, coordinates - j)):
                sig[some, j + k] = np.minimum.reduceat(np.ascontiguousarray(halves[:, 1 - k]), start)
    return sig


def parities(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bitmaps of each set (uint64 words): whether the shingles that fall on a bit are odd in number."""
    at = np.repeat(np.arange(len(n)), n) * PARITY_BITS + (h >> np.uint64(40)).astype(np.int64) % PARITY_BITS
    odd = np.bincount(at, minlength=len(n) * PARITY_BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(n), PARITY_BITS), axis=1).view(np.uint64)


def could_be_alike(x: np.ndarray, y: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """By the parity bitmaps of pairs of sets and the sum of their sizes: false only if the sets are not alike enough."""
    differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return differ * (10000 + percent) <= size * (10000 - percent)


def tokens_of(sig: np.ndarray) -> np.ndarray:
    """40 bits of a hash of coordinate and value; the last byte is the coordinate."""
    at = np.arange(sig.shape[1], dtype=np.uint64)
    return A.mix((sig.astype(np.uint64) << np.uint64(16)) | at) >> np.uint64(24) << np.uint64(8) | at


def rows_of(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def cells(blocks: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For postings of so many blocks, of which a member is in block `mine`: (which posting, lower block, upper block, is it on the upper side)."""
    which = np.repeat(np.arange(len(blocks)), blocks)
    other = A.spread(np.zeros(len(blocks), np.int64), blocks)
    own = mine[which]
    return which, np.minimum(own, other), np.maximum(own, other), own > other


HEAD = ("rid", "component", "n")


def deal(keys: np.ndarray):
    """For mapInArrow over (rid, component, n, low, odd, tokens, blocks): each document once to every bucket that one of its cells falls into."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            head = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            sig = rows_of(b.column(3), np.uint8)
            odd = rows_of(b.column(4), np.uint64)
            token = b.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            blocks = b.column(6).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), b.column(5).value_lengths().to_numpy(zero_copy_only=False))
            mask = np.zeros(sig.shape, bool)
            mask[doc, token & 255] = True
            bits = np.packbits(mask, axis=1)
            spot = A.mix(head[0][doc].view(np.uint64) + np.uint64(11)) % blocks.astype(np.uint64)
            which, low, high, upper = cells(blocks, spot.astype(np.int64))
            token, doc = token[which], doc[which]
            bucket = (A.mix_with(token.view(np.uint64), (low << 32 | high).view(np.uint64)) % np.uint64(len(keys))).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            starts = A.group_starts(bucket[order])
            out = []
            for s, n in zip(starts, A.group_lengths(starts, len(order))):
                rows = order[s : s + n]
                mine, local = np.unique(doc[rows], return_inverse=True)
                raw = [np.array([len(mine), n], np.int64), *(h[mine] for h in head), sig[mine], bits[mine], odd[mine], token[rows], low[rows] << 32 | high[rows], local.astype(np.int64), upper[rows]]
                out.append((int(keys[bucket[rows[0]]]), A.squeeze(b"".join(x.tobytes() for x in raw))))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "payload"])

    return run


def undeal(payload: bytes, coordinates: int):
    """The arrays of one payload of deal()."""
    raw = A.unsqueeze(payload)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    at, out = 16, []
    for kind, count in (*[(np.int64, n)] * 3, (np.uint8, n * coordinates), (np.uint8, n * -(-coordinates // 8)), (np.uint64, n * PARITY_BITS // 64), *[(np.int64, m)] * 3, (np.bool_, m)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    out[3:6] = [x.reshape(n, -1) for x in out[3:6]]
    return out


def planes_of(sig: np.ndarray) -> np.ndarray:
    """The two low bits of every coordinate as two rows of machine words."""
    pad = np.zeros((len(sig), -sig.shape[1] % 64), np.uint8)
    return np.stack([np.packbits(np.concatenate((sig >> k & 1, pad), 1), axis=1).view(np.uint64) for k in (0, 1)])


class Forest:
    """Components that pairs would join, if they were all links."""

    def __init__(self, component: np.ndarray):
        self.of = np.unique(component, return_inverse=True)[1]
        self.root = np.arange(int(self.of.max(initial=-1)) + 1)

    def labels(self, who: np.ndarray) -> np.ndarray:
        return self.root[self.of[who]]

    def find(self, i: int) -> int:
        while self.root[i] != i:
            i = int(self.root[i])
        return i

    def edges(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Places of the pairs that join two components, each after those before it; the rest would join nothing new."""
        out, at = [], np.arange(len(p))
        while len(at := at[self.labels(p[at]) != self.labels(q[at])]):
            for i in at[np.unique(self.labels(p[at]), return_index=True)[1]].tolist():
                a, b = self.find(int(self.of[p[i]])), self.find(int(self.of[q[i]]))
                if a != b:
                    self.root[max(a, b)] = min(a, b)
                    out.append(i)
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]
        return np.array(out, np.int64)


def meet(coordinates: int, similarity: float, need: int, percent: int, forest: bool = False, rows: int = 128, columns: int = 2048):
    """For mapInArrow over what deal() sends: pairs (a, b) of different components that share a token, agree often enough
    and could be alike by size. A pair comes from its first TIMES common tokens only. Two bits of every coordinate are
    compared for whole blocks of pairs at once, and all eight for the few pairs that this leaves, so that a long posting
    takes time, but neither rows nor memory. With `forest`, only those pairs are given that join components of the bucket
    which no pair before them joins: fewer than it has documents."""
    spare = -coordinates % 64
    need_bits = enough_matches(coordinates, similarity + (1 - similarity) / 4) + spare

    def run(batches):
        parts, base = [], 0
        for b in batches:
            for p in b.column(1).to_pylist():
                got = undeal(p, coordinates)
                got[8] = got[8] + base
                base += len(got[0])
                parts.append(got)
        if not parts:
            return
        rid, component, size, sig, bits, odd, token, cell, owner, upper = (np.concatenate(c) for c in zip(*parts))
        del parts
        planes = planes_of(sig)
        trees = Forest(component)
        order = np.lexsort((size[owner], upper, cell, token))
        token, cell, owner, upper = token[order], cell[order], owner[order], upper[order]
        starts = A.group_starts(token, cell)
        for s, n in zip(starts.tolist(), A.group_lengths(starts, len(token)).tolist()):
            who, coordinate = owner[s : s + n], int(token[s] & 255)
            alone = cell[s] >> 32 == cell[s] & 0xFFFFFFFF
            cut = int(np.searchsorted(upper[s : s + n], True))
            left, right = (who, who) if alone else (who[:cut], who[cut:])
            n_right = size[right]
            for i in range(0, len(left), rows):
                x = left[i : i + rows]
                lo = i if alone else int(np.searchsorted(n_right, size[x[0]] * percent // 10000, "left"))
                hi = int(np.searchsorted(n_right, size[x[-1]] * 10000 // percent, "right"))
                for j in range(lo, hi, columns):
                    y = right[j : min(j + columns, hi)]
                    ok = trees.labels(x)[:, None] != trees.labels(y)[None, :]
                    if alone:
                        ok &= np.arange(i, i + len(x))[:, None] < np.arange(j, j + len(y))[None, :]
                    if not ok.any():
                        continue
                    agree = np.zeros(ok.shape, np.uint16)
                    for w in range(planes.shape[2]):
                        differ = (planes[0, x, w][:, None] ^ planes[0, y, w][None, :]) | (planes[1, x, w][:, None] ^ planes[1, y, w][None, :])
                        agree += np.uint16(64) - np.bitwise_count(differ)
                    ok &= agree >= need_bits
                    u, v = np.nonzero(ok)
                    for k in range(0, len(u), 1 << 14):
                        p, q = x[u[k : k + (1 << 14)]], y[v[k : k + (1 << 14)]]
                        near = could_be_alike(odd[p], odd[q], size[p] + size[q], percent)
                        p, q = p[near], q[near]
                        same = sig[p] == sig[q]
                        hit = np.flatnonzero((same.sum(1) >= need) & (10000 * np.minimum(size[p], size[q]) >= percent * np.maximum(size[p], size[q])))
                        if not len(hit):
                            continue
                        p, q, same = p[hit], q[hit], same[hit]
                        common = same & np.unpackbits(bits[p] & bits[q], axis=1, count=coordinates).astype(bool)
                        mine = np.flatnonzero(common[:, :coordinate].sum(1) < TIMES)
                        if forest:
                            mine = mine[trees.edges(p[mine], q[mine])]
                        a, b = np.minimum(rid[p[mine]], rid[q[mine]]), np.maximum(rid[p[mine]], rid[q[mine]])
                        if len(a):
                            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def filter_of(ids: DataFrame):
    """A test of Arrow columns of ids that is true for all given ids (and null) and for few others. Its size is bounded, whatever their number."""
    spark = ids.sparkSession
    n = ids.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * n).bit_length()))
    at = F.pmod("doc_id", F.lit(bits))  # ids spread evenly enough, and neighbours share words
    words = ids.where("doc_id is not null").select(at.alias("at")).groupBy(F.floor(F.col("at") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("v"))
    table = words.toPandas()  # bits / 32 rows at most
    seen = np.zeros(bits // 32, np.uint64)
    seen[table["w"].to_numpy(np.int64)] = table["v"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(seen.astype(np.uint32))

    def test(column: pa.Array) -> np.ndarray:
        known = pc.fill_null(column, 0).to_numpy(zero_copy_only=False) % bits
        return ((shared.value[known >> 5] >> (known & 31).astype(np.uint32)) & 1 == 1) | column.is_null().to_numpy(zero_copy_only=False)

    return test


def compare(percent: int):
    """For mapInArrow over (a, salt, role, rid, n, part, shingles) in the order of the first six: pairs (a, rid) alike enough.
    A representative's own set (role 0) comes before those it is compared with; one set and one part are held at a time."""

    def run(batches):
        at = hub_parts = hub = None
        hub_n, other, seen, both = 0, None, -1, 0
        out = []

        def close():
            if other is not None and 10000 * both >= percent * (hub_n + other[1] - both):
                out.append((at[0], other[0]))

        for b in batches:
            for a, salt, role, rid, n, part, raw in zip(*(b.column(i).to_pylist() for i in range(7))):
                if (a, salt) != at:
                    close()
                    at, hub_parts, hub, hub_n, other = (a, salt), {}, None, n, None
                if role == 0:
                    hub_parts[part] = np.frombuffer(raw, np.uint64)
                    continue
                if hub is None:
                    hub = np.concatenate([hub_parts[i] for i in sorted(hub_parts)])
                if other is None or other[0] != rid:
                    close()
                    other, seen, both = (rid, n), -1, 0
                if part != seen:  # a set may come twice, if two rows have the same id and words
                    x = np.frombuffer(raw, np.uint64)
                    i = np.searchsorted(hub, x)
                    i[i == len(hub)] = 0
                    both += int((hub[i] == x).sum())
                    seen = part
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
                out.clear()
        if at is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return run


def near_duplicates(df: DataFrame, shingle_words: int = 5, similarity: float = 0.8, coordinates: int = COORDINATES, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, stays and the columns carried of every row."""
    spark = ship(df.sparkSession)
    n_parts = partitions(spark)
    need = enough_matches(coordinates, similarity)
    prefix = coordinates - need + 1
    percent = round(similarity * 10000)
    docs, names, kinds = private(df, id_col, text_col, carry)

    def base(batches):
        for b in batches:
            for i, j, texts in text_chunks(b.column(1)):
                h, n = shingle_runs(texts, shingle_words)
                sig = sketch(h, n, coordinates)
                binary = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                cols = [b.column(0).slice(i, j - i), pa.array(n, pa.int64()), *map(pa.array, fingerprints(h, n)), binary(sig), binary(parities(h, n))]
                yield pa.RecordBatch.from_arrays([*cols, *(b.column(c).slice(i, j - i) for c in names)], names=["doc_id", "n", "f1", "f2", "sig", "odd", *names])

    sketches = stored(docs.mapInArrow(A.releasing(base), "doc_id long, n long, f1 long, f2 long, sig binary, odd binary" + kinds).withColumn("row", F.monotonically_increasing_id()), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = stored(sketches.where("n > 0").groupBy("n", "f1", "f2").agg(first.alias("first"), F.count("*").alias("copies")), "sets").withColumn("rid", F.col("first.row"))
    reps = stored(sketches.join(groups.select("rid"), F.col("row") == F.col("rid"), "left_semi").select(F.col("row").alias("rid"), "doc_id", "n", "f1", "f2", "sig", "odd"), "representatives")

    def post(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rid = b.column(0).to_numpy(zero_copy_only=False)
            sig = rows_of(b.column(1), np.uint32)
            token = tokens_of(sig).ravel()
            who = np.repeat(rid, sig.shape[1])
            bucket = ((token >> np.uint64(8)) % np.uint64(n_parts)).astype(np.int64)
            order = np.lexsort((who, bucket))
            starts = A.group_starts(bucket[order])
            rows = [(int(keys[bucket[order[s]]]), A.pack(n, [(token[order[s : s + n]], 6), (who[order[s : s + n]], 8)])) for s, n in zip(starts, A.group_lengths(starts, len(order)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])

    def shared(batches):
        parts = [A.unpack(p, [("<u8", 6), ("<i8", 8)]) for b in batches for p in b.column(1).to_pylist()]
        if not parts:
            return
        token, who = (np.concatenate(c) for c in zip(*parts))
        del parts
        order = np.argsort(token, kind="stable")
        token, who = token[order], who[order]
        starts = A.group_starts(token)
        lens = A.group_lengths(starts, len(token))
        df_ = np.repeat(lens, lens)
        keep = np.flatnonzero(df_ > 1)
        for i in range(0, len(keep), 50_000):
            s = keep[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(who[s]), pa.array(token[s].view(np.int64)), pa.array(df_[s], pa.int64())], names=["rid", "token", "df"])

    keys = A.aligned_keys(n_parts)
    counted = reps.select("rid", "sig").mapInArrow(A.releasing(post), "bucket int, payload binary").repartition(n_parts, "bucket").mapInArrow(A.releasing(shared), "rid long, token long, df long")
    # the rarest values come first; those of one document alone take their places in the prefix, but have no partner
    listed = counted.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("all")).where(F.size("all") >= need)
    listed = listed.join(reps.select("rid", "n"), "rid")
    posts = stored(listed.select("rid", "n", F.explode(F.slice("all", 1, F.greatest(F.lit(0), prefix - (coordinates - F.size("all"))))).alias("p")).select("rid", "n", F.col("p.token").alias("token")), "posts")

    def shorten(batches):
        for b in batches:
            low = [r.tobytes() for r in rows_of(b.column(2), np.uint32).astype(np.uint8)] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(low, pa.binary()), b.column(3)], names=["rid", "n", "low", "odd"])

    lows = stored(reps.select("rid", "n", "sig", "odd").mapInArrow(A.releasing(shorten), "rid long, n long, low binary, odd binary"), "short")

    def alike(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those whose signatures agree often enough and whose bitmaps are near enough."""

        def count(batches):
            for b in batches:
                if b.num_rows:
                    size = sum(b.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
                    same = (rows_of(b.column(3), np.uint8) == rows_of(b.column(6), np.uint8)).sum(1)
                    near = could_be_alike(rows_of(b.column(4), np.uint64), rows_of(b.column(7), np.uint64), size, percent)
                    yield b.select([0, 1]).filter(pa.array((same >= need) & near))

        side = lambda x: lows.select(F.col("rid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "low", "odd")))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "low_a", "odd_a", "n_b", "low_b", "odd_b").mapInArrow(A.releasing(count), "a long, b long")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b), those whose full shingle sets are alike enough. The cells of a hot `a` are as many as there are tasks."""
        cell = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(n_parts)).cast("int").alias("salt"), "b")
        needs = cell.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("rid")).distinct().union(cell.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("rid")))
        wanted = needs.select("rid").distinct().join(reps.select("rid", "doc_id", "n", "f1", "f2"), "rid")
        near_enough = filter_of(wanted.select("doc_id"))

        def full(batches):
            for b in batches:
                b = b.filter(pa.array(near_enough(b.column(0))))
                for _, _, texts in text_chunks(b.column(1)):
                    h, n = shingle_runs(texts, shingle_words)
                    f1, f2 = fingerprints(h, n)
                    parts = -(-n // PART)
                    of = np.repeat(np.arange(len(n)), parts)
                    nth = A.spread(np.zeros(len(n), np.int64), parts)
                    begin = np.repeat(np.cumsum(n) - n, parts) + nth * PART
                    size = np.minimum(PART, n[of] - nth * PART)
                    raw = [h[s : s + m].tobytes() for s, m in zip(begin.tolist(), size.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(n[of], pa.int64()), pa.array(f1[of]), pa.array(f2[of]), pa.array(nth, pa.int32()), pa.array(raw, pa.binary())], names=["n", "f1", "f2", "part", "shingles"])

        sets = docs.select("doc_id", "text").mapInArrow(A.releasing(full), "n long, f1 long, f2 long, part int, shingles binary")
        named = sets.join(wanted.select("rid", "n", "f1", "f2"), ["n", "f1", "f2"]).select("rid", "n", "part", "shingles")
        rows = needs.join(named, "rid").select("a", "salt", "role", "rid", "n", "part", "shingles")
        return rows.repartition(n_parts, "a", "salt").sortWithinPartitions("a", "salt", "role", "rid", "part").mapInArrow(A.releasing(compare(percent)), "a long, b long")

    hubs = posts.groupBy("token").agg(F.min(F.struct("rid", "n")).alias("hub"), F.count("*").alias("m")).where("m > 1").select("token", F.col("hub.rid").alias("a"), F.col("hub.n").alias("na"))
    met = posts.join(hubs, "token").where((F.col("rid") > F.col("a")) & (10000 * F.least("n", "na") >= percent * F.greatest("n", "na"))).groupBy("a", F.col("rid").alias("b")).agg(F.count("*").alias("c"))
    best = met.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", (-F.col("a")).alias("a"))), asc=False), 1, HUBS).alias("x"))
    star = best.select("b", F.explode("x.a").alias("a")).select((-F.col("a")).alias("a"), "b")
    star = stored(alike(star), "star")
    links = stored(confirmed(star), "confirmed")
    found = components(links, "a", "b")

    def crossing(found: DataFrame, forest: bool) -> DataFrame:
        """Distinct pairs of different components that could be alike, all of them or a forest."""
        labelled = posts.join(found, F.col("rid") == F.col("id"), "left").select("token", "rid", "n", F.coalesce("component", "rid").alias("component"))
        labelled = stored(labelled, "labelled")
        mixed = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo < hi")
        mixed = stored(mixed.select("token", "m", F.ceil(F.col("m") / CELL_MEMBERS).cast("int").alias("blocks")), "mixed")
        members = mixed.agg(F.sum(F.col("m") * F.col("blocks"))).first()[0] or 0
        buckets = max(n_parts, -(-members // BUCKET_MEMBERS))
        open_ = labelled.join(mixed.select("token", "blocks"), "token").groupBy("rid").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.collect_list(F.struct("token", "blocks")).alias("t"))
        open_ = open_.join(lows.drop("n"), "rid").select("rid", "component", "n", "low", "odd", "t.token", "t.blocks")
        dealt = open_.mapInArrow(A.releasing(deal(A.aligned_keys(buckets))), "bucket int, payload binary").repartition(buckets, "bucket")
        return stored(dealt.mapInArrow(A.releasing(meet(coordinates, similarity, need, percent, forest)), "a long, b long").distinct(), "crossing")

    trees = crossing(found, True)
    links = links.union(stored(confirmed(trees.join(star, ["a", "b"], "left_anti")), "confirmed"))
    if not trees.join(links, ["a", "b"], "left_anti").isEmpty():  # an edge that is no link may have hidden others
        found = components(links, "a", "b")
        rest = crossing(found, False).join(star.union(trees), ["a", "b"], "left_anti")
        links = links.union(stored(confirmed(stored(rest, "rest")), "confirmed"))
    found = components(links, "a", "b")

    # every set's component: the least id and the first row of all that it can reach
    of = groups.join(found, F.col("rid") == F.col("id"), "left").withColumn("component", F.coalesce("component", "rid"))
    head = of.groupBy("component").agg(F.min("first").alias("head"), F.count("*").alias("sets"))
    facts = join_unskewed(of, head, "component", "sets").select("n", "f1", "f2", "copies", F.col("head.doc_id").alias("component_id"), F.col("head.row").alias("head"))
    cols = ["doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")]
    some = join_unskewed(sketches.where("n > 0").drop("sig", "odd"), stored(facts, "facts"), ["n", "f1", "f2"], "copies").select(*cols, (F.col("row") == F.col("head")).alias("stays"), *names)
    none = sketches.where("n = 0").withColumn("component_id", F.col("doc_id")).select(*cols, F.lit(True).alias("stays"), *names)
    return public(some.union(none), carry, names)
