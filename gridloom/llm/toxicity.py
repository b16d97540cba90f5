"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its lower-cased words, their leading 4, 5 and 6 bytes (so that inflected
forms share evidence), adjacent pairs and pairs with one or two words between. Each coordinate has its own learning rate
and an L1 penalty keeps most weights at zero; what is left is a small table of (hash, weight) that is broadcast.

The model is fitted on a bounded sample of labelled rows: at most `per_class` of label 1 and `clean_ratio` times as many
of label 0, chosen by a hash of the id, and of these, in that order, those whose texts fit into `sample_bytes`; so the one
task that fits it reads and holds a bounded sample. Every text is scored whole, however long.

Defined results: null and wordless texts get the score of no features; if the usable labels lack one of the two classes (or
there are none, or no documents), every score is 0; null labels and null ids are no training rows; repeated labels of an id
count once, as the highest; repeated documents are training rows each; rows with equal ids are scored each by itself; other
columns are ignored unless named in `carry` (one named like a result comes out with `_in` behind its name).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.llm import arrays as A
from gridloom.llm.columns import private, public
from gridloom.session import ship

PER_CLASS, CLEAN_RATIO = 3000, 2
#: And bytes of their texts; a row that does not fit any more is no training row.
SAMPLE_BYTES = 64 << 20
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1.0, 0.05
#: Texts that are scored at once.
ROWS_AT_ONCE = 1000
#: Passes over the sample: as many as make so many updates, or the least. Small samples need more to be sure of what they show.
UPDATES, LEAST_EPOCHS = 120_000, 6
#: A feature is learned if so many training texts have it.
MIN_TEXTS = 3
#: And if twice the log likelihood ratio against having nothing to do with the label is so much (chance: about 1 in 2000). Where it speaks for
#: label 1, less will do, so that a word of three texts, all of label 1, is learned in a full sample (6.59): the L1 penalty selects among those.
LEAST_RATIO, LEAST_RATIO_TOXIC = 12.0, 6.5
#: Bits of the hash by which features are counted before they are screened.
SLOT_BITS = 24
STEMS = (4, 5, 6)
SKIPS = (1, 2, 3)

APART = np.zeros(256, bool)
APART[:128] = [not chr(c).isalnum() for c in range(128)]


def features(texts: list[bytes]):
    """Yields (first text, end text, hashes, text of each hash), not yet distinct, for runs of texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for a, b in A.chunks(sizes):
        raw = [t.decode("utf-8", "replace").lower().encode() for t in texts[a:b]]
        buf, begin, end, first, count, word = A.words_of(raw, APART)
        roll = A.Rolling(A.BYTE_VALUES[buf])
        doc = np.repeat(np.arange(b - a), count)
        keys, docs = [word], [doc]
        for n in STEMS:
            at = np.flatnonzero(end - begin > n)
            keys.append(A.mix(roll.ranges(begin[at], begin[at] + n) + np.uint64(1000 + n)))
            docs.append(doc[at])
        for gap in SKIPS:
            if len(word) > gap:
                at = np.flatnonzero(doc[gap:] == doc[:-gap])
                keys.append(A.mix_with(word[at] + np.uint64(gap), word[at + gap]))
                docs.append(doc[at])
        yield a, b, np.concatenate(keys), np.concatenate(docs)


def distinct(texts: list[bytes]):
    """features(), each hash once per text, in the order of the texts."""
    for a, b, keys, docs in features(texts):
        _, first = np.unique(A.mix_with(keys, docs.astype(np.uint64)), return_index=True)
        first = first[np.argsort(docs[first], kind="stable")]
        yield a, b, keys[first], docs[first]


def ratio(n1: np.ndarray, n: np.ndarray, total1: float, total: float) -> np.ndarray:
    """Twice the log likelihood ratio of n1 of n texts with label 1, against the rate of all texts."""
    rate = total1 / total

    def part(x, y):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(x / (y * rate)), 0) + np.where(y > x, (y - x) * np.log((y - x) / (y * (1 - rate))), 0)

    return 2 * (part(n1, n) + part(total1 - n1, np.maximum(total - n, 1e-9)))


def says_something(n1: np.ndarray, n: np.ndarray, total1: float, total: float, slack: float = 1.0) -> np.ndarray:
    """Whether features of n texts, n1 of label 1, differ from the rate of all texts beyond chance; less will do where label 1 is the commoner."""
    least = np.where(n1 * total > n * total1, LEAST_RATIO_TOXIC, LEAST_RATIO)
    return ratio(n1, n, total1, total) >= least * slack


def telling(texts: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Features of at least MIN_TEXTS texts whose share differs between the labels beyond chance, and each text's own of them.

    Counts by a part of the hash screen the features first, so that memory does not grow with their number.
    """
    slot, kind = np.uint64((1 << SLOT_BITS) - 1), np.uint16 if len(texts) < 20_000 else np.uint32
    n, n1 = np.zeros(1 << SLOT_BITS, kind), np.zeros(1 << SLOT_BITS, kind)
    for a, _, keys, docs in distinct(texts):
        at = (keys & slot).astype(np.int64)
        np.add.at(n, at, kind(1))
        np.add.at(n1, at[labels[a + docs] > 0], kind(1))
    good = np.zeros(1 << SLOT_BITS, bool)
    for i in range(0, len(n), 1 << 20):  # in slices: the test takes many numbers a slot
        busy = i + np.flatnonzero(n[i : i + (1 << 20)] >= MIN_TEXTS)
        good[busy] = says_something(n1[busy].astype(float), n[busy].astype(float), labels.sum(), len(labels), 0.5)
    del n, n1
    rows: list[np.ndarray] = []
    for a, b, keys, docs in distinct(texts):
        keep = good[(keys & slot).astype(np.int64)]
        keys, docs = keys[keep], docs[keep]
        cut = np.searchsorted(docs, np.arange(b - a + 1))
        rows += [keys[cut[i] : cut[i + 1]] for i in range(b - a)]
    if not rows:
        return np.zeros(0, np.uint64), []
    keys = np.concatenate(rows)
    toxic = np.sort(keys[np.repeat(labels > 0, [len(r) for r in rows])])
    keys.sort()
    first = A.group_starts(keys)
    exact, keys = A.group_lengths(first, len(keys)).astype(float), keys[first]
    exact1 = (np.searchsorted(toxic, keys, "right") - np.searchsorted(toxic, keys, "left")).astype(float)
    vocabulary = keys[(exact >= MIN_TEXTS) & says_something(exact1, exact, labels.sum(), len(labels))]
    ids = []
    for k in rows:
        at = np.searchsorted(vocabulary, k)
        at[at == len(vocabulary)] = 0
        ids.append(at[vocabulary[at] == k] if len(vocabulary) else at[:0])
    return vocabulary, ids


def fit(texts: list[bytes], labels: np.ndarray, epochs: int | None = None, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes and weights that are not zero, and the bias."""
    vocabulary, ids = telling(texts, labels)
    z, n = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
    bias = len(vocabulary)
    rng = np.random.default_rng(9)

    def weights(i, penalty):
        big = np.abs(z[i]) > penalty
        return np.where(big, -(z[i] - np.sign(z[i]) * penalty) / ((beta + np.sqrt(n[i])) / alpha + l2), 0.0)

    penalty = np.full(len(vocabulary) + 1, l1)
    penalty[bias] = 0.0
    for _ in range(epochs or max(LEAST_EPOCHS, UPDATES // max(1, len(ids)))):
        for r in rng.permutation(len(ids)):
            i = np.append(ids[r], bias)
            w = weights(i, penalty[i])
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[r]
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    w = weights(np.arange(len(z)), penalty)
    some = np.flatnonzero(w[:-1])
    return vocabulary[some], w[some], float(w[bias])


class Model:
    """Weights by hash. A small bitmap turns most features away before they are looked up."""

    BITS = 22

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[(keys & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for a, b, keys, docs in features(texts):
            near = np.flatnonzero(self.seen[(keys & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
            keys, docs = keys[near], docs[near]
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
            pairs = np.unique(docs[hit] * (len(self.keys) + 1) + at[hit])
            doc, feature = np.divmod(pairs, len(self.keys) + 1)
            out[a:b] += np.bincount(doc, self.weights[feature], b - a)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, clean_ratio: int = CLEAN_RATIO, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """A model from the labelled rows given (the caller leaves held-out rows away); None without both classes."""
    ship(docs.sparkSession)
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("double").alias("label"))
    by_hash = F.xxhash64("doc_id", F.lit("toxicity"))
    sample = usable.where("label = 1").orderBy(by_hash).limit(per_class).union(usable.where("label = 0").orderBy(by_hash).limit(per_class * clean_ratio))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(sample), "doc_id").withColumn("h", by_hash)  # bounded by per_class

    def run(batches):
        texts, marks, room = [], [], sample_bytes
        for b in batches:
            for text, mark in zip(b.column(1), b.column(2)):
                size = len(text.as_buffer()) if text.is_valid else 0
                if size <= room:
                    room -= size
                    texts.append(text.as_py() or b"")
                    marks.append(mark.as_py())
        y = np.array(marks)
        order = sorted(range(len(texts)), key=lambda i: (texts[i], marks[i]))
        if len({*marks}) == 2:
            keys, w, bias = fit([texts[i] for i in order], y[order])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, np.uint64(0)).view(np.int64)), pa.array(np.append(w, bias)), pa.array([False] * len(w) + [True])], names=["key", "weight", "bias"])

    found = rows.repartition(1).sortWithinPartitions("h", "label", F.length("text"), "text").mapInArrow(A.releasing(run), "key long, weight double, bias boolean").collect()
    if not found:
        return None
    keys = np.array([r.key for r in found if not r.bias], np.int64).view(np.uint64)
    weights = np.array([r.weight for r in found if not r.bias])
    order = np.argsort(keys)
    return Model(keys[order], weights[order], next(r.weight for r in found if r.bias))


def score_toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score of every row, and the columns carried."""
    spark = ship(docs.sparkSession)
    rows, names, kinds = private(docs, id_col, text_col, carry)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            scores = np.zeros(b.num_rows)
            for i in range(0, b.num_rows if shared.value else 0, ROWS_AT_ONCE):
                texts = [x or b"" for x in b.column(1).slice(i, ROWS_AT_ONCE).cast(pa.binary()).to_pylist()]
                scores[i : i + ROWS_AT_ONCE] = shared.value.score(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), *(b.column(c) for c in names)], names=["doc_id", "score", *names])

    return public(rows.mapInArrow(A.releasing(run), "doc_id long, score double" + kinds), carry, names)
