"""Substring dedup by seed and extend: remove every word of a long word sequence that also starts earlier.

Documents are joined on winnowed anchors (the seeds). A seed is extended both ways over the words that its windows
cover: seeds with equal extensions settle at once, the others compare window by window (see repeats), and adjoining
windows merge into maximal repeats.

Defined results: a null text has no words; a text of fewer words than the window keeps them all; rows with equal ids
follow each other in the order of their texts; a null id comes after all others; other columns are dropped unless named
in `carry`, which may name any but the result's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm import repeats as R
from gridloom.llm.columns import private, public

ANCHOR_WORDS = 8
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"


def dedup_substrings(df: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed word ranges) and kept_text (kept words, one space between) of every document."""
    df, names, kinds = private(df, id_col, text_col, carry)
    plan = R.Plan(min_words, min(ANCHOR_WORDS, min_words), True, True, "doc_id", "text", "text" in names)
    schema = RESULT + kinds

    def finish(docs: R.Docs, piece, covered) -> pa.Table:
        a, n = (piece[0], len(piece[-1])) if piece else (0, 0)
        words, kept, removed, lo, hi, n_spans = [], [], [], [], [], []
        if piece:
            _, _, buf, begin, end, first, count = piece
            raw = buf.tobytes()
            b, e = begin.tolist(), end.tolist()
            for f, c in zip(first.tolist(), count.tolist()):
                mine = covered[f : f + c]
                words.append(c)
                removed.append(int(mine.sum()))
                if removed[-1]:
                    s, t = R.spans_of(mine)
                    lo.append(s), hi.append(t)
                    n_spans.append(len(s))
                    at = (np.flatnonzero(~mine) + f).tolist()
                else:
                    n_spans.append(0)
                    at = range(f, f + c)
                kept.append(b" ".join([raw[b[i] : e[i]] for i in at]).decode("utf-8", "replace"))
        offsets = pa.array(np.concatenate(([0], np.cumsum(n_spans))).astype(np.int32))
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (lo, hi)], names=["start", "end"])
        own = {"doc_id": docs.table["doc_id"].slice(a, n), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.ListArray.from_arrays(offsets, flat), "kept_text": pa.array(kept, pa.string())}
        cols = [*own.values(), *(docs.table[c].slice(a, n) for c in names)]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=[*own, *names])

    return public(R.find_repeats(df, plan, finish, schema), carry, names)
