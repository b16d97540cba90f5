"""Suffix-array dedup: remove every byte of a long string that also starts in an earlier document.

Suffixes are range-partitioned by their leading bytes with sampled splitters; each bucket sorts its own by multikey
quicksort, and leads that go on beyond a splitter are compared across the boundary (see repeats.settle). The array is
sparse: of the suffixes of one window, that at its winnowed anchor stands for it, which is the same one wherever the
window occurs, so no match is lost.

Defined results: a null text is empty; a text shorter than the window keeps all its bytes; rows with equal ids are not
before one another; a null id comes after all others; other columns are ignored unless named in `carry`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.llm import arrays as A
from gridloom.llm import repeats as R

#: Bytes of an anchor. Longer ones are contested less often; shorter ones are fewer.
ANCHOR_BYTES = 24
#: Sampled suffixes for each bucket (about so many of them reach the driver for each, whatever the input), and documents that give them.
PER_BUCKET, SAMPLE_DOCS = 64, 2000

SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def sampled_splitters(df: DataFrame, plan: R.Plan, n: int) -> list[np.ndarray] | None:
    """n - 1 suffix starts at most that part the sampled suffixes evenly; None if there is nothing to sample."""
    if n < 2:
        return None
    n_docs, n_bytes = df.agg(F.count("*"), F.sum(F.octet_length(plan.text_col))).first()
    every = max(1, n_docs // max(SAMPLE_DOCS, n))
    some = df.where(F.pmod(F.xxhash64(plan.id_col, F.lit("splitters")), F.lit(every)) == 0)
    # about 2 / (t - k + 2) of all bytes are anchors; each partition gives its share of the sample and no more
    anchors = max(1.0, 2 * (n_bytes or 0) / every / (plan.t - plan.k + 2))
    below = np.uint64(min(1.0, PER_BUCKET * n / anchors) * float((1 << 64) - 1025))

    def sample(batches):
        for b in batches:
            found = R.find(R.in_order(pa.Table.from_batches([b]), plan), plan)
            cols = [*found.lead, found.cover]
            at = np.flatnonzero(A.mix(found.cover) <= below)
            yield pa.RecordBatch.from_pydict({"row": pa.array([b"".join(int(w[i]).to_bytes(8, "little") for w in cols) for i in at], pa.binary())})

    rows = some.select(plan.id_col, plan.text_col).mapInArrow(sample, "row binary").collect()
    if not rows:
        return None
    words = np.frombuffer(b"".join(bytes(r[0]) for r in rows), np.uint64).reshape(len(rows), -1)
    words = words[A.multikey_order([np.ascontiguousarray(c) for c in words.T])]
    at = np.unique(np.arange(1, n) * len(words) // n)
    return [np.ascontiguousarray(c) for c in words[at].T]


def dedup_suffixes(df: DataFrame, min_bytes: int = 50, id_col: str = "doc_id", text_col: str = "text", anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed byte ranges) and kept (remaining bytes) of every document."""
    plan = R.Plan(min_bytes, min(anchor_bytes, min_bytes) // 8 * 8, False, False, id_col, text_col)
    if plan.k < 8:
        raise ValueError("min_bytes must be 8 or more")

    def finish(docs: R.Docs, piece, covered) -> pa.Table:
        if piece is None:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "spans": pa.array([], SPANS), "kept": pa.array([], pa.binary())})
        a, _, buf, _, _, first, count = piece
        kept, removed, lo, hi, n_spans = [], [], [], [], []
        for i, (f, c) in enumerate(zip(first.tolist(), count.tolist())):
            mine = covered[f : f + c]
            if not mine.any():
                kept.append(docs.texts[a + i])
                removed.append(0)
                n_spans.append(0)
                continue
            kept.append(buf[f : f + c][~mine].tobytes())
            removed.append(int(mine.sum()))
            s, e = R.spans_of(mine)
            lo.append(s), hi.append(e), n_spans.append(len(s))
        offsets = pa.array(np.concatenate(([0], np.cumsum(n_spans))).astype(np.int32))
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (lo, hi)], names=["start", "end"])
        return pa.table({"doc_id": docs.table[id_col].slice(a, len(kept)).cast(pa.int64()), "n_bytes": pa.array(count, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.ListArray.from_arrays(offsets, flat), "kept": pa.array(kept, pa.binary())})

    return R.find_repeats(df.select(id_col, text_col), plan, finish, SCHEMA, sampled_splitters)
