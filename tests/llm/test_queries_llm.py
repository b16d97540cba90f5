"""The registered queries on small tables: the contract's columns, and rows against plain versions."""

import math
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

SOUNDS = {"en": ["the", "ing", "sh"], "de": ["sch", "ung", "ver"], "es": ["ción", "ñe", "illa"]}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(21)
    text = lambda lang, n: " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(3)) for _ in range(n))
    docs, labels = [], []
    for i in range(160):
        lang = list(SOUNDS)[i % 3]
        t = text(lang, r.randint(20, 60))
        if i % 5 == 0:
            t += " filthscum"
        docs.append((i, t, lang if i % 7 else None, f"s{i % 4}" if i % 11 else None))
        labels.append((i, int(i % 5 == 0)))
    docs += [(200, docs[3][1], None, "s1"), (201, docs[4][1] + " end", None, "s2"), (202, None, None, "s1"), (203, "", "en", "s1"), (204, " 12 ! ", None, None), (205, text("en", 9000), None, "s0")]
    passage = text("de", 40)
    docs += [(210 + k, f"{text('en', 30)} {passage} {text('es', 30)}", None, "s2") for k in range(3)]
    item = " ".join(brute.NORMAL_WORD.findall(passage)[5:17])
    pages = [(i, f"http://a.example/{i % 2}", f"<nav>{text('en', 3)}</nav><article><h1>A &amp; {i}</h1><p>{text('es', 5)}</p></article><footer>x</footer>") for i in range(8)]
    pages += [(20, None, None), (21, "u", pages[2][2]), (22, "u", "")]
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)] + [(150, None), (200, [1.0, None]), (250, [math.nan])]
    d = str(tmp_path_factory.mktemp("tables"))
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    put([(*x, len(x[1] or "")) for x in docs], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    put([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int", "labels")
    put([(1, item), (2, "nothing like it"), (3, None)], "item_id long, text string", "benchmark")
    put(pages, "page_id long, url string, html string", "pages")
    put([(*v, 0) for v in vectors], "vec_id long, embedding array<double>, label int", "embeddings")
    return d, docs, pages, vectors, [(1, item), (2, "nothing like it"), (3, None)]


COLUMNS = {
    "op1_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op2_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op3_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op4_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op6_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op7_exact_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op8_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
}


def rows_of(spark, tables, name):
    from gridloom.llm.queries import QUERIES

    out = QUERIES[name](spark, tables[0])
    kinds = dict(out.dtypes)
    want = [c.split(" ") for c in COLUMNS[name].split(", ")]
    assert {c: kinds[c] for c, _ in want} == dict(want)
    return out.select(*(c for c, _ in want)).collect()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_ops_on_documents_against_plain_versions(spark, tables):
    docs = [(i, t) for i, t, *_ in tables[1]]
    for name, plain in (("op1_decontamination", lambda: brute.decontaminate(docs, tables[4])), ("op2_suffix_dedup", lambda: brute.suffixes(docs)), ("op5_substring_dedup", lambda: brute.substrings(docs)), ("op10_minhash", lambda: brute.near(docs))):
        assert {r[0]: tuple(r[1:]) for r in rows_of(spark, tables, name)} == plain(), name


def test_op3_op6_op7(spark, tables):
    _, _, pages, vectors, _ = tables
    text = {i: "\n\n".join([f"A & {i}", h.split("<p>")[1].split("</p>")[0]]) if h and "<p>" in h else "" for i, _, h in pages}
    text[21] = text[2]
    got = rows_of(spark, tables, "op3_html_extraction")
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in got} == {i: (u, text[i], len(text[i])) for i, u, _ in pages}
    assert {r[0]: tuple(r[1:]) for r in rows_of(spark, tables, "op6_warc")} == brute.warc(pages)
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in rows_of(spark, tables, "op7_exact_topk")} == brute.topk(vectors)


def plain_language(text, samples, segment=256):
    """Greedy longest phrases, by looking them up in the samples; segments are parsed each by itself."""
    from gridloom.llm import langid as L

    t = L.normal(text or "")
    if not t or not samples:
        return "und", 0.0
    cost = {}
    for lang in sorted(samples):
        n = 0
        for at in range(0, len(t), segment):
            part, i = t[at : at + segment], 0
            while i < len(part):
                j = i + 1
                while j < len(part) and part[i : j + 1] in samples[lang]:
                    j += 1
                n, i = n + 1, j
        cost[lang] = n * (math.log2(max(1, len(samples[lang]))) + L.LENGTH_BITS)
    best = min(sorted(cost), key=lambda k: cost[k])
    rest = min(v for k, v in cost.items() if k != best)
    return best, min(1.0, max(0.0, 1 - 0.5 * cost[best] / rest))


def test_op4_against_plain_parsing(spark, tables):
    from gridloom.llm.langid import train

    docs = {i: (t, lang) for i, t, lang, _ in tables[1]}
    learned = spark.read.parquet(f"{tables[0]}/documents.parquet")
    samples = train(learned.where(learned.doc_id.isin([i for i in docs if not held_out(i)])))
    for r in rows_of(spark, tables, "op4_language_id"):
        lang, score = plain_language(docs[r.doc_id][0], samples)
        assert (r.held_out, r.lang_pred) == (held_out(r.doc_id), lang) and r.score == pytest.approx(score), r
        assert r.lang_pred == (docs[r.doc_id][1] or r.lang_pred) or not docs[r.doc_id][0]


def test_op8_against_plain_targets(spark, tables):
    from test_operators_llm import plain_targets

    size, of = {}, {}
    for i, t, _, s in tables[1]:
        n = len(brute.BLANK_WORD.findall((t or "").encode()))
        of[i] = (n, s)
        size[s] = size.get(s, 0) + n
    target, taken = plain_targets(size), {}
    got = rows_of(spark, tables, "op8_source_mixing")
    for r in got:
        n, s = of[r.doc_id]
        assert (r.size, r.source_size) == (n, size[s]) and r.target == pytest.approx(target[s])
        assert r.taken in ([0] if not n else range(0, 3 * n + 1, n))
        taken[s] = taken.get(s, 0) + r.taken
    most = {s: max(n for n, x in of.values() if x == s) for s in size}
    assert len(got) == len(of) and all(abs(taken[s] - target[s]) <= most[s] for s in size)  # one document decides the rest
    assert sorted(map(str, rows_of(spark, tables, "op8_source_mixing"))) == sorted(map(str, got))


def test_op9_contract(spark, tables):
    got = rows_of(spark, tables, "op9_toxicity")
    assert {r.doc_id for r in got} == {i for i, *_ in tables[1]} and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.held_out == held_out(r.doc_id) and r.predicted == int(r.score >= 0.7)
        if r.doc_id < 160:
            assert r.predicted == int(r.doc_id % 5 == 0)


def test_ftrl_against_a_plain_version(monkeypatch):
    from gridloom.llm import toxicity as T

    r = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(r.choice(words[: 20 if i % 3 else 30]) for _ in range(12)).encode() for i in range(60)]
    labels = np.array([float(i % 3 == 0) for i in range(60)])
    keys, weights, bias = T.fit(texts, labels, epochs=5)
    vocabulary, ids = T.telling(texts, labels)
    z, n = {}, {}

    def weight(j):
        penalty, at = 0.0 if j == "bias" else T.L1, z.get(j, 0.0)
        return 0.0 if abs(at) <= penalty else -(at - math.copysign(penalty, at)) / ((T.BETA + math.sqrt(n.get(j, 0.0))) / T.ALPHA + T.L2)

    order = np.random.default_rng(9)
    for _ in range(5):
        for row in order.permutation(len(ids)):
            here = [*ids[row].tolist(), "bias"]
            w = {j: weight(j) for j in here}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[row]
            for j in here:
                step = (math.sqrt(n.get(j, 0.0) + g * g) - math.sqrt(n.get(j, 0.0))) / T.ALPHA
                z[j] = z.get(j, 0.0) + g - step * w[j]
                n[j] = n.get(j, 0.0) + g * g
    want = {int(vocabulary[j]): weight(j) for j in range(len(vocabulary)) if weight(j)}
    assert {int(k): w for k, w in zip(keys, weights)} == pytest.approx(want) and bias == pytest.approx(weight("bias")) and len(want) > 3
