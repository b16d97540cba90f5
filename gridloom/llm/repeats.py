"""Windows of a fixed number of tokens that also start earlier: the engine of both substring operators.

Three passes over blocks of documents (a block: all documents whose id hashes alike, in the order of their ids):

1. Each window belongs to one winnowed anchor. Anchors travel to buckets as (tokens that lead at the anchor,
   fingerprint of all the tokens its windows cover, document). An anchor whose whole cover is found in an earlier
   document is settled there; one whose leading tokens occur with other covers is contested; the rest is unique.
2. Contested anchors travel again with their windows, which are compared one by one.
3. Each block marks its tokens.

Answers come back as a few bits per anchor in the order in which a block sent them, so that blocks find their own
anchors again by repeating the (deterministic) winnowing. Texts are shuffled once; all three passes reuse that exchange.
A block sends equal covers once, so a passage in a third of all documents makes a row per block and not per document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gridloom.llm import arrays as A
from gridloom.session import partitions, ship

SENT = "bucket int, blk int, kind int, payload binary"
ANSWER = "blk int, src int, kind int, payload binary"
SENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("blk", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
ANSWER_SCHEMA = pa.schema([("blk", pa.int32()), ("src", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
COVERED, CONTESTED = 1, 2
CARRY, MARKS, WINDOWS = 0, 1, 2
#: Records worked on at once where all of them would take many numbers each.
SLICE = 1 << 16
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Plan:
    """t: tokens of a window; k: tokens of an anchor; words: tokens are words and not bytes; own: an earlier start in the same document counts; carried: the text comes out again."""

    t: int
    k: int
    words: bool
    own: bool
    id_col: str
    text_col: str
    carried: bool = False


@dataclass
class Anchors:
    doc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    lead: list[np.ndarray]
    cover: np.ndarray


@dataclass
class Docs:
    """table: all columns, the text only if it is carried."""

    table: pa.Table
    ids: np.ndarray
    texts: list[bytes]


def in_order(table: pa.Table, plan: Plan) -> Docs:
    """The rows of a block in the order of id (null last) and text, whatever order the shuffle brought."""
    ids = pc.fill_null(table[plan.id_col].cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)
    texts = table[plan.text_col].cast(pa.binary()).to_pylist()
    order = np.argsort(ids, kind="stable")
    if len(ids) and (np.diff(ids[order]) == 0).any():
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] is not None, texts[i] or b"")), np.int64)
    others = table if plan.carried else table.drop_columns([plan.text_col])
    return Docs(others.take(pa.array(order)), ids[order], [texts[i] or b"" for i in order.tolist()])


def pieces(docs: Docs, plan: Plan):
    """(first document, texts, token hashes, bytes or None, word starts and ends, first token and number of tokens of each text) of about CHUNK bytes."""
    sizes = np.fromiter(map(len, docs.texts), np.int64, len(docs.texts))
    for a, b in A.chunks(sizes):
        texts = docs.texts[a:b]
        if plan.words:
            buf, begin, end, first, count, tokens = A.words_of(texts)
            yield a, tokens, buf, begin, end, first, count
        else:
            buf = np.frombuffer(b"".join(texts), np.uint8)
            count = sizes[a:b]
            yield a, A.BYTE_VALUES[buf], buf, None, None, np.concatenate(([0], np.cumsum(count)[:-1])), count


def big_endian(buf: np.ndarray, at: np.ndarray, n: int = 8) -> np.ndarray:
    """Bytes at..at+n as a number that sorts as they do."""
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        out = (out << np.uint64(8)) | buf[at + i].astype(np.uint64)
    return out


def find(docs: Docs, plan: Plan) -> Anchors:
    """Anchors of a block, in the order of the documents. lo and hi count within a piece."""
    parts = []
    for piece in pieces(docs, plan):
        a, tokens, buf, _, _, first, count = piece
        roll = A.Rolling(tokens)
        at, lo, hi, grams = A.winnow(roll, first, count, plan.k, plan.t)
        doc = np.searchsorted(first, at, "right") - 1
        while len(doc) and (short := count[doc] == 0).any():  # empty documents share their start with the next
            doc = doc - short
        lead = [A.mix(grams[at])] if plan.words else [big_endian(buf, at + i) for i in range(0, plan.k, 8)]
        cover = A.mix_with(A.mix(roll.ranges(lo, hi + plan.t)), ((at - lo) * 4096 + (hi - lo)).astype(np.uint64))
        parts.append([(doc + a).astype(np.int32), lo.astype(np.int32), hi.astype(np.int32), *lead, cover])
    n_lead = 1 if plan.words else plan.k // 8
    cols = [A.joined(parts, i, np.int32 if i < 3 else np.uint64) for i in range(4 + n_lead)]
    return Anchors(*cols[:3], cols[3 : 3 + n_lead], cols[3 + n_lead])


@dataclass
class Sent:
    """What a block sends: `pick` is the anchor that stands for each record (in the order sent); `record` the record of each anchor."""

    pick: np.ndarray
    record: np.ndarray
    bucket: np.ndarray


def records(found: Anchors, bucket_of) -> Sent:
    n = len(found.cover)
    if not n:
        z = np.zeros(0, np.int32)
        return Sent(z, z, z)
    h = found.cover
    for w in found.lead:
        h = A.mix_with(h, w)
    order = np.argsort(h, kind="stable").astype(np.int32)  # anchors are in document order: the first of each run is the earliest
    starts = A.group_starts(h[order])
    del h
    lens = A.group_lengths(starts, n).astype(np.int32)
    pick = order[starts]
    del starts
    bucket = np.empty(len(pick), np.int32)
    for i in range(0, len(pick), SLICE):
        some = pick[i : i + SLICE]
        bucket[i : i + SLICE] = bucket_of([w[some] for w in found.lead], found.cover[some])
    by = np.lexsort((found.lead[0][pick], bucket)).astype(np.int32)
    rank = np.empty(len(by), np.int32)
    rank[by] = np.arange(len(by), dtype=np.int32)
    record = np.empty(n, np.int32)
    record[order] = np.repeat(rank, lens)
    return Sent(pick[by], record, bucket[by])


def widths(plan: Plan) -> list[tuple[str, int]]:
    """Lead words, the cover's fingerprint (compared among equal leads only), document."""
    return [*([("<u8", 8)] * (1 if plan.words else plan.k // 8)), ("<u8", 8), ("<i8", 8)]


def sections(bucket: np.ndarray):
    starts = A.group_starts(bucket)
    return [(int(bucket[s]), s, s + n) for s, n in zip(starts, A.group_lengths(starts, len(bucket)))]


def sent_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 4, SENT_SCHEMA.types)], schema=SENT_SCHEMA)


def spread_by_hash(keys: np.ndarray):
    """Buckets by a hash of the lead."""
    return lambda lead, cover: (A.mix(lead[0] + np.uint64(1)) % np.uint64(len(keys))).astype(np.int64)


def spread_by_splitters(split: list[np.ndarray]):
    """Buckets by sampled splitters: rows (lead..., cover) in order; a hot lead may fill several buckets."""

    def bucket_of(lead, cover):
        lo, hi = np.searchsorted(split[0], lead[0], "left"), np.searchsorted(split[0], lead[0], "right")
        out = lo.copy()
        tied = np.flatnonzero(hi > lo)
        row = [w[tied] for w in [*lead[1:], cover]]
        for j in range(int((hi - lo).max(initial=0))):
            at = np.minimum(lo[tied] + j, len(split[0]) - 1)
            above, equal = np.zeros(len(tied), bool), np.ones(len(tied), bool)
            for mine, s in zip(row, split[1:]):
                above |= equal & (mine > s[at])
                equal &= mine == s[at]
            out[tied] += (lo[tied] + j < hi[tied]) & above
        return out

    return bucket_of


def settle(lead: list[np.ndarray], cover: np.ndarray, doc: np.ndarray, edges: list[np.ndarray] | None) -> np.ndarray:
    """COVERED, CONTESTED or 0 for every record of a bucket. edges: leads of the splitters; equal leads may lie beyond them.
    The records' columns are put in order in place: they fill most of what a bucket takes."""
    n = len(doc)
    order = A.multikey_order([*lead, cover, doc.view(np.uint64)])
    state = np.zeros(n, np.uint8)
    if not n:
        return state
    order = order.astype(np.int32)
    for w in (*lead, cover, doc):
        w[:] = w[order]
    same = A.group_starts(*lead, cover)
    run = A.group_lengths(same, n)
    out = (doc > np.repeat(doc[same], run)).astype(np.uint8) * np.uint8(COVERED)
    g = A.group_starts(*lead)
    glen = A.group_lengths(g, n)
    kinds = np.diff(np.append(np.searchsorted(same, g), len(same)))
    contested = kinds > 1
    if edges is not None and len(edges[0]):
        for j in range(len(edges[0])):  # compare across boundaries: a splitter's own lead goes on in the next bucket
            contested |= np.logical_and.reduce([w[g] == e[j] for w, e in zip(lead, edges)])
    out[(out == 0) & np.repeat(contested, glen)] = CONTESTED
    state[order] = out
    return state


def later(windows: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether a window's hash also comes with an earlier (document, place)."""
    order = np.lexsort((place, doc, windows))
    starts = A.group_starts(windows[order])
    lens = A.group_lengths(starts, len(order))
    d, p = doc[order], place[order]
    out = np.zeros(len(order), bool)
    out[order] = (d > np.repeat(d[starts], lens)) | (p > np.repeat(p[starts], lens)) & (d == np.repeat(d[starts], lens))
    return out


def reduce_marks(plan: Plan, keys: np.ndarray, edges: dict[int, list[np.ndarray]] | None):
    def run(batches):
        rows, parts = [], []
        for b in batches:
            for blk, bucket, payload in zip(b["blk"].to_pylist(), b["bucket"].to_pylist(), b["payload"]):
                parts.append(A.unpack(payload.as_py(), widths(plan)))
                rows.append((blk, bucket, len(parts[-1][0])))
        if not rows:
            return
        del b, payload
        cols = [A.joined(parts, i) for i in range(len(widths(plan)))]
        del parts
        state = settle(cols[:-2], cols[-2], cols[-1], edges and edges.get(rows[0][1]))
        del cols
        at = 0
        out = []
        for blk, bucket, n in rows:
            bits = state[at : at + n]
            out.append((blk, bucket, MARKS, A.squeeze(np.packbits(np.stack((bits == COVERED, bits == CONTESTED))).tobytes())))
            at += n
        A.release()
        yield from answers(out)

    return run


def answers(rows) -> list[pa.RecordBatch]:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 4, ANSWER_SCHEMA.types)], schema=ANSWER_SCHEMA).to_batches()


def state_of(found: Anchors, docs: Docs, sent: Sent, rows: list[dict], plan: Plan) -> np.ndarray:
    """The state of every anchor from the answers about its record."""
    state = np.zeros(len(sent.pick), np.uint8)
    got = {r["src"]: r["payload"] for r in rows if r["kind"] == MARKS}
    for b, s, e in sections(sent.bucket):
        bits = np.unpackbits(np.frombuffer(A.unsqueeze(got[b]), np.uint8), count=2 * (e - s)).reshape(2, -1)
        state[s:e] = bits[0] * COVERED + bits[1] * CONTESTED
    mine = state[sent.record]
    first = sent.pick[sent.record]
    here = np.arange(len(mine))
    after = first < here if plan.own else docs.ids[found.doc] > docs.ids[found.doc[first]]
    return np.where(after, COVERED, mine).astype(np.uint8)


def gather_windows(docs: Docs, plan: Plan, found: Anchors, state: np.ndarray):
    """Of the contested anchors, piece by piece: their windows' hashes (words), or the bytes that they cover, and how many windows each has."""
    out, seen = [], 0
    for a, tokens, buf, _, _, _, count in pieces(docs, plan):
        upto = int(np.searchsorted(found.doc, a + len(count), "left"))
        c = seen + np.flatnonzero(state[seen:upto] == CONTESTED)
        seen = upto
        lo, n = found.lo[c], (found.hi[c] - found.lo[c] + 1).astype(np.int64)
        if not plan.words:
            out.append([buf[A.spread(lo, n + plan.t - 1)], n])
        elif len(c):
            s = A.spread(lo, n)
            out.append([A.mix(A.Rolling(tokens).ranges(s, s + plan.t)), n])
    return A.joined(out, 0, np.uint64 if plan.words else np.uint8), A.joined(out, 1)


def contested_bucket(lead: list[np.ndarray], n: int) -> np.ndarray:
    h = lead[0]
    for w in lead[1:]:
        h = A.mix_with(h, w)
    return (A.mix(h + np.uint64(7)) % np.uint64(n)).astype(np.int64)


def send_windows(docs: Docs, found: Anchors, plan: Plan, state, flat, n_win, n_buckets):
    """(bucket, payload) of the contested anchors, and their order."""
    c = np.flatnonzero(state == CONTESTED)
    bucket = contested_bucket([w[c] for w in found.lead], n_buckets)
    order = np.argsort(bucket, kind="stable")
    length = n_win if plan.words else n_win + plan.t - 1
    start = np.concatenate(([0], np.cumsum(length)))[:-1].astype(np.int64)
    rows = []
    for b, s, e in sections(bucket[order]):
        pick = order[s:e]
        data = flat[A.spread(start[pick], length[pick])]
        head = A.pack(e - s, [(docs.ids[found.doc[c[pick]]], 8), (n_win[pick].astype(np.int64), 3), (c[pick].astype(np.int64), 6)])
        rows.append((b, len(head).to_bytes(4, "little") + head + A.squeeze(data.tobytes())))
    return rows, c, bucket, order


def reduce_windows(plan: Plan):
    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        heads, data = [], []
        out = [(r["blk"], r["bucket"], MARKS, r["payload"]) for r in rows if r["kind"] == CARRY]
        rows = [r for r in rows if r["kind"] == WINDOWS]
        for r in rows:
            p = r["payload"]
            size = int.from_bytes(p[:4], "little")
            heads.append(A.unpack(p[4 : 4 + size], [("<i8", 8), ("<i8", 3), ("<i8", 6)]))
            data.append(A.unsqueeze(p[4 + size :]))
        if rows:
            doc, n_win, place = (np.concatenate(c) for c in zip(*heads))
            if plan.words:
                windows = np.frombuffer(b"".join(data), np.uint64)
                within = A.spread(np.zeros(len(n_win), np.int64), n_win)
            else:
                tokens = A.BYTE_VALUES[np.frombuffer(b"".join(data), np.uint8)]
                span = n_win + plan.t - 1
                start = np.concatenate(([0], np.cumsum(span)[:-1]))
                s = A.spread(start, n_win)
                within = s - np.repeat(start, n_win)
                windows = np.concatenate([A.mix(x) for x in range_hashes(tokens, s, plan.t)]) if len(s) else np.zeros(0, np.uint64)
                windows = by_bytes(windows, np.frombuffer(b"".join(data), np.uint8), s, plan.t)
            place = np.repeat(place, n_win) * 4096 + within if plan.own else np.zeros(len(windows), np.int64)
            hit = later(windows, np.repeat(doc, n_win), place)
            at = 0
            for r, h in zip(rows, heads):
                n = int(h[1].sum())
                out.append((r["blk"], r["bucket"], WINDOWS, A.squeeze(np.packbits(hit[at : at + n]).tobytes())))
                at += n
        if out:
            yield from answers(out)

    return run


def by_bytes(windows: np.ndarray, raw: np.ndarray, s: np.ndarray, t: int) -> np.ndarray:
    """The hashes of raw[s:s+t], if equal hashes have equal bytes; else numbers that do."""
    order = np.argsort(windows, kind="stable")
    starts = A.group_starts(windows[order])
    first = np.repeat(order[starts], A.group_lengths(starts, len(order)))
    twin = np.flatnonzero(order != first)
    for i in range(0, len(twin), 1 << 18):
        at, ref = s[order[twin[i : i + (1 << 18)]]], s[first[twin[i : i + (1 << 18)]]]
        if any((raw[at + k] != raw[ref + k]).any() for k in range(t)):
            rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, t)[s])
            return np.unique(rows.view(np.dtype((np.void, t))).ravel(), return_inverse=True)[1].astype(np.uint64)
    return windows


def range_hashes(tokens: np.ndarray, s: np.ndarray, t: int, step: int = 1 << 20):
    """Hashes of tokens[s:s+t], s ascending, worked on in slices so that the prefix tables stay small."""
    for i in range(0, len(s), step):
        part = s[i : i + step]
        base = int(part[0])
        roll = A.Rolling(tokens[base : int(part[-1]) + t])
        yield roll.ranges(part - base, part - base + t)


def removed_tokens(docs: Docs, plan: Plan, rows: list[dict], bucket_of, n_buckets: int, finish: Callable) -> None:
    """Call finish(piece, covered tokens) for each piece of the block."""
    found = find(docs, plan)
    sent = records(found, bucket_of)
    state = state_of(found, docs, sent, rows, plan)
    del sent
    c = np.flatnonzero(state == CONTESTED)
    n_win = (found.hi[c] - found.lo[c] + 1).astype(np.int64)
    bucket = contested_bucket([w[c] for w in found.lead], n_buckets)
    order = np.argsort(bucket, kind="stable")
    got = {r["src"]: r["payload"] for r in rows if r["kind"] == WINDOWS}
    flags = np.zeros(int(n_win.sum()), bool)
    start = np.concatenate(([0], np.cumsum(n_win)))[:-1].astype(np.int64)
    for b, s, e in sections(bucket[order]):
        pick = order[s:e]
        n = int(n_win[pick].sum())
        flags[A.spread(start[pick], n_win[pick])] = np.unpackbits(np.frombuffer(A.unsqueeze(got[b]), np.uint8), count=n).astype(bool)
    seen, seen_w = 0, 0
    for piece in pieces(docs, plan):
        a, tokens, _, _, _, first, count = piece
        n, end = len(tokens), a + len(count)
        upto = int(np.searchsorted(found.doc, end, "left"))
        lo, hi, st = found.lo[seen:upto], found.hi[seen:upto], state[seen:upto]
        edge = np.zeros(n + 1, np.int32)
        full = st == COVERED
        np.add.at(edge, lo[full], 1)
        np.add.at(edge, hi[full] + 1, -1)
        hit = np.cumsum(edge)[:n] > 0
        mine = st == CONTESTED
        w = A.spread(lo[mine], hi[mine] - lo[mine] + 1)
        hit[w] |= flags[seen_w : seen_w + len(w)]
        total = np.concatenate((np.zeros(plan.t, np.int64), np.cumsum(hit)))
        finish(piece, total[plan.t :] > total[: n])
        seen, seen_w = upto, seen_w + len(w)


def spans_of(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return edge[0::2], edge[1::2]


def blocks(df: DataFrame, plan: Plan, keys: np.ndarray) -> DataFrame:
    """df with the block of each row; a null id has block 0 of its own hash."""
    n = len(keys)
    lookup = F.array(*[F.lit(int(k)) for k in keys]) if n <= 512 else None
    at = F.pmod(F.xxhash64(F.col(plan.id_col)), F.lit(n)).cast("int")
    blk = F.element_at(lookup, at + 1) if lookup is not None else at
    return df.withColumn("blk", blk)


def find_repeats(df: DataFrame, plan: Plan, finish: Callable, schema: str, splitters: Callable | None = None) -> DataFrame:
    """finish(docs, iterator of (piece, covered tokens)) -> Arrow table of `schema`, called for each block."""
    spark = ship(df.sparkSession)
    n = partitions(spark)
    keys = A.aligned_keys(n)
    split = splitters(df, plan, n) if splitters else None
    bucket_of = spread_by_splitters(split) if split else spread_by_hash(keys)
    edges = None
    if split:
        m = len(split[0])
        edges = {int(keys[b]): [np.array([w[j] for j in (b - 1, b) if 0 <= j < m], np.uint64) for w in split[:-1]] for b in range(n)}
    text = blocks(df, plan, keys)

    def first(table: pa.Table) -> pa.Table:
        blk = table["blk"][0].as_py()
        docs = in_order(table, plan)
        found, ids = find(docs, plan), docs.ids
        del docs
        sent = records(found, bucket_of)
        rows, wide = [], widths(plan)
        for b, s, e in sections(sent.bucket):
            pick = sent.pick[s:e]
            cols = [*(w[pick] for w in found.lead), found.cover[pick], ids[found.doc[pick]]]
            rows.append((int(keys[b]), blk, MARKS, A.pack(e - s, [(x, w) for x, (_, w) in zip(cols, wide)])))
        del found, sent
        out = sent_table(rows)
        del rows
        A.release()
        return out

    def renumbered(table: pa.Table) -> list[dict]:
        number = {int(k): i for i, k in enumerate(keys)}
        return [r | {"src": number[r["src"]]} for r in table.to_pylist()]

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return sent_table([])
        blk = left["blk"][0].as_py()
        docs, rows = in_order(left, plan), renumbered(right)
        found = find(docs, plan)
        sent = records(found, bucket_of)
        state = state_of(found, docs, sent, rows, plan)
        del sent
        flat, n_win = gather_windows(docs, plan, found, state)
        out, _, _, _ = send_windows(docs, found, plan, state, flat, n_win, n)
        del docs, found, state, flat, n_win
        A.release()
        return sent_table([(int(keys[b]), blk, WINDOWS, p) for b, p in out] + [(int(keys[r["src"]]), blk, CARRY, r["payload"]) for r in rows])

    def third(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = in_order(left, plan)
        done = []
        removed_tokens(docs, plan, renumbered(right), bucket_of, n, lambda piece, covered: done.append(finish(docs, piece, covered)))
        A.release()
        return pa.concat_tables(done) if done else finish(docs, None, None)

    sent1 = text.groupBy("blk").applyInArrow(first, SENT)
    marks = sent1.repartition(n, "bucket").mapInArrow(A.releasing(reduce_marks(plan, keys, edges)), ANSWER)
    sent2 = text.groupBy("blk").cogroup(marks.groupBy("blk")).applyInArrow(second, SENT)
    hits = sent2.repartition(n, "bucket").mapInArrow(A.releasing(reduce_windows(plan)), ANSWER)
    return text.groupBy("blk").cogroup(hits.groupBy("blk")).applyInArrow(third, schema)
