"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items and documents are normalised alike: A-Z to lower case, every other ASCII character that is neither a
digit nor a letter to a blank, words parted by single blanks. The automaton holds every window of consecutive item words
between blanks, so it matches whole words only, and each text is scanned once. Matches come with the words that they
cover and, through the words' own offsets, with byte ranges of the original text.

The items go to the workers with a checked size: sets of more than `most_bytes` are split into blocks of items, which take
their turns: the driver reads and sends one at a time, a pass over the documents with that block's automaton stores the hits,
and the hits of all passes are merged per document. (An item is in one block: a single item may exceed the bound.)

Defined results: null and wordless texts have no words and no hits, nor has anything without items; an item of fewer words
than a window is one window; a wordless item never occurs; items with equal ids count as one; texts of any length are scanned
whole; rows of the documents with equal or null ids are kept apart; other columns are ignored unless named in `carry` (one
named like a result comes out with `_in` behind its name).
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.llm import arrays as A
from gridloom.llm.columns import private, public
from gridloom.session import ship, stored

#: Benchmark text in one automaton, and read to the driver at a time. The automaton of a megabyte takes about 0.45 GB in each worker.
MOST_BYTES = 512 << 10

_built: dict[str, object] = {}


def normal_table() -> bytes:
    """Byte by byte: lower case, digits, letters and bytes above 0x7F stay, the rest turns blank."""
    return bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


NORMAL = normal_table()


def words_in(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


def windows_of(items: list[tuple[str, bytes]], window: int) -> dict[str, tuple[int, list[int]]]:
    """Normalised windows between blanks: (words, items that have it)."""
    out: dict[str, tuple[int, list[int]]] = {}
    for i, (_, text) in enumerate(items):
        w = words_in(text)
        for j in range(max(1, len(w) - window + 1) if w else 0):
            part = w[j : j + window]
            key = f" {b' '.join(part).decode('latin-1')} "
            n, who = out.setdefault(key, (len(part), []))
            if not who or who[-1] != i:
                who.append(i)
    return out


def automaton(key: str, items, window: int):
    """Built once in each worker process."""
    if key not in _built:
        import ahocorasick

        _built.clear()
        auto = ahocorasick.Automaton()
        for text, value in windows_of(items, window).items():
            auto.add_word(text, (len(text), *value))
        if len(auto):
            auto.make_automaton()
        _built[key] = auto
    return _built[key]


def scan(text: bytes | None, auto) -> tuple[int, list[tuple[int, int]], set[int]]:
    """(words, ranges of words that are hit, items found)."""
    w = words_in(text)
    if not w or not len(auto):
        return len(w), [], set()
    flat = f" {b' '.join(w).decode('latin-1')} "
    found, items = [], set()
    for end, (length, n, who) in auto.iter(flat):
        found.append((end - length + 1, n))
        items.update(who)
    if not found:
        return len(w), [], items
    blanks = np.flatnonzero(np.frombuffer(flat.encode("latin-1"), np.uint8) == 32)
    first = np.searchsorted(blanks, np.array([f[0] for f in found]))
    ranges: list[list[int]] = []
    for s, n in sorted(zip(first.tolist(), (f[1] for f in found))):
        if ranges and s <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], s + n)
        else:
            ranges.append([s, s + n])
    return len(w), [(s, e) for s, e in ranges], items


def original_ranges(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges in the original text of ranges of words."""
    buf = np.frombuffer(text.translate(NORMAL) + b" ", np.uint8) == 32
    edge = np.flatnonzero(np.diff(np.concatenate(([True], buf)).view(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    return [(int(begin[s]), int(end[e - 1])) for s, e in ranges]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most_bytes: int):
    """The items as (id as string, text), in blocks of bounded size; one at a time is read to the driver."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").cast("binary").alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // most_bytes)
    for k in range(n):
        yield [(r.i, bytes(r.t)) for r in (rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)).collect()]


PAIRS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "n_words long, word_spans array<struct<start:long,end:long>>, byte_spans array<struct<start:long,end:long>>, items array<string>"
NAMES = ["n_words", "word_spans", "byte_spans", "items"]


def findings(texts: list[bytes | None], spans: list[list[tuple[int, int]]], items: list[set[str]]) -> list[pa.Array]:
    as_pairs = lambda rows: pa.array([[{"start": s, "end": e} for s, e in r] for r in rows], PAIRS)
    origin = [original_ranges(t, s) if s else [] for t, s in zip(texts, spans)]
    return [pa.array([len(words_in(t)) for t in texts], pa.int64()), as_pairs(spans), as_pairs(origin), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]


def scanning(shared, window: int, only_hits: bool, names: list[str]):
    """For mapInArrow over (first column, text, ...): the first column, what is found in the text, and the columns named."""
    key = uuid.uuid4().hex

    def run(batches):
        for b in batches:
            auto = automaton(key, shared.value, window)
            texts = b.column(1).cast(pa.binary()).to_pylist()
            got = [scan(t, auto) for t in texts]
            if only_hits:
                at = [i for i, x in enumerate(got) if x[1]]
                b, texts, got = b.take(pa.array(at, pa.int64())), [texts[i] for i in at], [got[i] for i in at]
            cols = findings(texts, [x[1] for x in got], [{shared.value[w][0] for w in x[2]} for x in got])
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, *(b.column(c) for c in names)], names=[b.schema.names[0], *NAMES, *names])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_words, word_spans, byte_spans (of the original text), items (ids found, sorted as strings) of each document, and the columns carried."""
    spark = ship(docs.sparkSession)
    rows, names, kinds = private(docs, id_col, text_col, carry)
    blocks = item_blocks(benchmark, item_col, item_text_col, most_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        out = rows.mapInArrow(scanning(spark.sparkContext.broadcast(first), window, False, names), f"doc_id long, {FOUND}{kinds}")
        return public(out, carry, names)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
    hits = None
    for block in chain((first, second), blocks):
        shared = spark.sparkContext.broadcast(block)
        part = stored(rows.select("row", "text").mapInArrow(scanning(shared, window, True, []), f"row long, {FOUND}"), "hits")
        shared.unpersist()
        hits = part if hits is None else hits.union(part)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    hits = hits.groupBy("row").agg(flat("word_spans"), flat("items"))

    def combine(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            spans = [merge([(s["start"], s["end"]) for s in x or ()]) for x in b.column(b.schema.get_field_index("word_spans")).to_pylist()]
            items = [set(x or ()) for x in b.column(b.schema.get_field_index("items")).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *findings(texts, spans, items), *(b.column(c) for c in names)], names=["doc_id", *NAMES, *names])

    out = rows.join(hits, "row", "left").select("doc_id", "text", "word_spans", "items", *(c for c in names if c != "text")).mapInArrow(combine, f"doc_id long, {FOUND}{kinds}")
    return public(out, carry, names)


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def digest_of(items: list[str]) -> str:
    """The contract's digest of found items, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
