"""Language ID by cross-parsing: the language whose labelled text says a document in fewest bits wins.

For each language a suffix automaton is built of a bounded sample of its labelled text (normalised: letters in lower case,
anything else one blank). A text is parsed greedily into the longest phrases that occur in the sample. Each phrase costs
a pointer into the sample (the logarithm of its size) and a length; the sum estimates the cross entropy with that language
whatever the size of its sample. The automata are transition tables over the bytes that occur, so thousands of text
segments walk them at once in NumPy; a segment's last phrase is counted by the segment's end.

The sample: of at most `docs_per_language` labelled rows of each language, chosen by a hash of the id, those whose normalised
texts fit whole into `sample_bytes` one after another (if none does, the beginning of one). Every language keeps its own,
however little or much the others have; with equal sizes the bits are in the order of the phrases. What the driver reads and
sends grows with the number of languages, and with nothing else.

Defined results: null texts and those without a letter are `und` with score 0; without labelled text everything is `und`;
with one language everything with a letter is that one; ties go to the language first by code point.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.llm import arrays as A
from gridloom.llm.columns import private, public
from gridloom.session import ship

DOCS_PER_LANGUAGE, SAMPLE_BYTES = 80, 24_000
#: Bits of a phrase's length. A tiny sample, of which any letter is a phrase, costs more than a language's own full sample.
LENGTH_BITS = 4.0
#: Bytes of transition tables, and of their transitions, that a worker keeps; those of further languages are made again when used.
TABLE_BYTES, MOVES_BYTES = 64 << 20, 128 << 20
SEGMENT = 256
#: ASCII that is no letter turns blank.
LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))

_built: dict[str, Models] = {}


def normal(text: str) -> bytes:
    """Words of letters with single blanks between; nothing if there is no letter."""
    out = b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS).split())
    return out if out.isascii() or any(map(str.isalpha, text)) else b""


def suffix_automaton(sample: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in sample:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


class Models:
    """One flat transition table per language over the bytes of all samples; -1 where a phrase ends."""

    def __init__(self, samples: dict[str, bytes], table_bytes: int = TABLE_BYTES, moves_bytes: int = MOVES_BYTES):
        self.langs = sorted(samples)
        self.samples = [samples[k] for k in self.langs]
        self.bits = np.array([np.log2(max(1, len(x))) + LENGTH_BITS for x in self.samples])
        used = sorted({c for x in self.samples for c in x})
        self.width = len(used) + 1
        self.code = np.zeros(256, np.int32)
        self.code[used] = np.arange(1, self.width)
        self.room = [table_bytes, moves_bytes]
        self.tables: dict[int, np.ndarray] = {}
        self.kept: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}

    def moves(self, j: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Size of a language's table, and the places and values of its transitions."""
        if j in self.kept:
            return self.kept[j]
        nxt = suffix_automaton(self.samples[j])
        n = np.fromiter(map(len, nxt), np.int64, len(nxt))
        total = int(n.sum())
        byte = np.fromiter((c for m in nxt for c in m), np.int64, total)
        to = np.fromiter((t for m in nxt for t in m.values()), np.int64, total)
        out = len(nxt) * self.width, (np.repeat(np.arange(len(nxt)), n) * self.width + self.code[byte]).astype(np.int32), (to * self.width).astype(np.int32)
        if out[1].nbytes * 2 <= self.room[1]:
            self.room[1] -= out[1].nbytes * 2
            self.kept[j] = out
        return out

    def table(self, j: int) -> np.ndarray:
        if j in self.tables:
            return self.tables[j]
        size, at, to = self.moves(j)
        t = np.full(size, -1, np.int32)
        t[at] = to
        if t.nbytes <= self.room[0]:
            self.room[0] -= t.nbytes
            self.tables[j] = t
            self.kept.pop(j, None)
        return t

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text by each language."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for a, b in A.chunks(sizes, 4 << 20):
            buf = self.code[np.frombuffer(b"".join(texts[a:b]), np.uint8)]
            size = sizes[a:b]
            n_seg = -(-size // SEGMENT)
            base = np.cumsum(size) - size
            seg_of = np.repeat(np.arange(b - a), n_seg)
            nth = A.spread(np.zeros(b - a, np.int64), n_seg)
            start = base[seg_of] + nth * SEGMENT
            length = np.minimum(SEGMENT, size[seg_of] - nth * SEGMENT)
            order = np.argsort(-length, kind="stable")
            start, length, seg_of = start[order], length[order], seg_of[order]
            active = np.searchsorted(-length, -np.arange(SEGMENT), "left")  # segments longer than each step
            for j in range(len(self.langs)):
                table = self.table(j)
                count = np.zeros(len(start), np.int32)
                state = np.zeros(len(start), np.int32)
                for step in range(SEGMENT):
                    n = active[step]
                    if not n:
                        break
                    c = buf[start[:n] + step]
                    to = table[state[:n] + c]
                    end = np.flatnonzero(to < 0)
                    if len(end):
                        count[end] += state[end] > 0
                        again = table[c[end]]  # the letter that ended a phrase begins the next
                        to[end] = np.maximum(again, 0)
                        count[end[again < 0]] += 1  # one that no sample has is a phrase of its own
                    state[:n] = to
                count += state > 0
                out[a:b, j] = np.bincount(seg_of, count, b - a)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        ready = [normal(t or "") for t in texts]
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        n = self.phrases(ready) * self.bits
        best = n.argmin(1)
        least = n[np.arange(len(n)), best]
        n[np.arange(len(n)), best] = np.inf
        second = n.min(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(least == 0, 0.0, 1 - 0.5 * least / second)
        lang = [self.langs[i] if t else "und" for i, t in zip(best.tolist(), ready)]
        return lang, np.where([bool(t) for t in ready], np.clip(score, 0, 1), 0.0)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Samples by language, from the labelled rows given (the caller leaves held-out rows away)."""
    ship(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(id_col, F.lit("langid")).alias("h"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    chosen = labelled.withColumn("nth", nth).where(F.col("nth") <= docs_per_language).select("lang", "h", "id")

    def clean(batches):
        for b in batches:
            texts = [normal(t) for t in b.column(2).to_pylist()]
            whole = [len(t) <= sample_bytes for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(whole), pa.array([t[:sample_bytes] for t in texts], pa.binary())], names=["lang", "h", "whole", "text"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(chosen), "id").select("lang", "h", "text")  # docs_per_language ids of each language
    gathered: dict[str, list] = {}
    for r in rows.mapInArrow(clean, "lang string, h long, whole boolean, text binary").collect():
        gathered.setdefault(r.lang, []).append((not r.whole, r.h, bytes(r.text)))
    return {k: v for k, v in ((k, fitting(sorted(x), sample_bytes)) for k, x in gathered.items()) if v}


def fitting(texts: list[tuple[bool, int, bytes]], room: int) -> bytes:
    """The texts that fit into so many bytes one after another, each whole, in the given order; if not even one does, the beginning of the first."""
    out = b""
    for too_long, _, t in texts:
        if t and (len(out) + len(t) + 1 <= room or not out):
            out = out + b" " + t if out else t
    return out


def models(key: str, samples: dict[str, bytes]) -> Models:
    """Built once in each worker process."""
    if key not in _built:
        _built.clear()
        _built[key] = Models(samples)
    return _built[key]


def identify_languages(docs: DataFrame, samples: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (1 less half the ratio of the least bits to the next) of every row, and the columns carried."""
    spark = ship(docs.sparkSession)
    rows, names, kinds = private(docs, id_col, text_col, carry)
    shared, key = spark.sparkContext.broadcast(samples), uuid.uuid4().hex

    def run(batches):
        for b in batches:
            lang, score = models(key, shared.value).predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), *(b.column(c) for c in names)], names=["doc_id", "lang_pred", "score", *names])

    return public(rows.mapInArrow(run, "doc_id long, lang_pred string, score double" + kinds), carry, names)
