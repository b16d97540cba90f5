"""The training-data operators against plain versions, on small tables with awkward rows."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string"


def corpus(seed=1, n=60):
    """Invented texts with copies, edits, shared passages, junk, nulls, one long text and white space of all kinds."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñßüÅZ1-.,!") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = text(45)
    out = [None, "", "   \n\t ", "one", "A B\x0bC\x0cD", "!!! ...", "aaaa" * 60, "x " * 90]
    for _ in range(n):
        k = r.random()
        if k < 0.2 and len(out) > 10:
            out.append(r.choice(out[8:]))
        elif k < 0.45 and len(out) > 10:
            w = (r.choice(out[8:]) or "").split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[r.randrange(len(w))] = "Edit"
            out.append(" ".join(w))
        elif k < 0.6:
            out.append(f"{text(r.randint(5, 60))} {passage}\n{text(r.randint(5, 60))}")
        else:
            out.append(text(r.randint(1, 150)))
    out.append(text(9000))
    r.shuffle(out)
    return [(i * 3, t) for i, t in enumerate(out)]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "en" if d % 2 else None, None if d % 5 == 0 else f"s{d % 4}", 0, "clash", "clash") for d, t in docs], SCHEMA).repartition(5)


def got(df, *cols):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *cols).collect()}


@pytest.fixture(scope="module", params=[1, 2])
def docs(request):
    return corpus(request.param)


def test_suffix_dedup(spark, docs):
    from gridloom.llm.suffix_dedup import dedup_suffixes

    out = dedup_suffixes(frame(spark, docs))
    assert got(out, "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)) == brute.suffixes(docs)
    assert got(dedup_suffixes(frame(spark, docs), min_bytes=17), "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)) == brute.suffixes(docs, 17)


def test_suffix_dedup_of_repeated_rows_and_nothing(spark):
    from gridloom.llm.suffix_dedup import dedup_suffixes

    t = "The same text of more than fifty bytes stands in each of these rows."
    out = dedup_suffixes(spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.n_removed) for r in out.collect()) == [("1", 0), ("1", 0), ("2", len(t)), ("None", len(t))]
    assert dedup_suffixes(out.select("doc_id", F.lit("").alias("text")).limit(0)).count() == 0


def test_substring_dedup(spark, docs):
    from gridloom.llm.substring_dedup import dedup_substrings

    assert got(dedup_substrings(frame(spark, docs)), "n_words", "n_removed", F.sha2("kept_text", 256)) == brute.substrings(docs)
    assert got(dedup_substrings(frame(spark, docs), min_words=5), "n_words", "n_removed", F.sha2("kept_text", 256)) == brute.substrings(docs, 5)
    carried = dedup_substrings(frame(spark, docs), carry=("text", "lang", "source"))
    assert {r.doc_id: r.text for r in carried.collect()} == dict(docs)
    assert dedup_substrings(frame(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize("words", [True, False])
def test_anchors_travel_with_whole_fingerprints(words):
    from gridloom.llm import arrays as A, repeats as R

    plan = R.Plan(20 if words else 50, 8, words, words, "doc_id", "text")
    wide = R.widths(plan)
    one = np.full(2, 5, np.uint64)
    far = np.array([9, 9 | 1 << 63], np.uint64)  # differ in the highest bit alone
    doc = np.array([1, 2], np.int64)
    for lead, cover in ((one, far), (far, one)):
        cols = [*([lead] * (len(wide) - 2)), cover, doc]
        back = A.unpack(A.pack(2, [(c, n) for c, (_, n) in zip(cols, wide)]), wide)
        assert R.COVERED not in R.settle(back[:-2], back[-2], back[-1], None)


def test_contested_windows_are_held_apart_by_their_bytes():
    from gridloom.llm import repeats as R

    raw = np.frombuffer(b"abcabcabdxabc", np.uint8)
    s = np.array([0, 3, 6, 10, 7])
    want = [raw[i : i + 3].tobytes() for i in s]
    for windows in (np.zeros(5, np.uint64), np.array([1, 1, 1, 1, 2], np.uint64), np.array([hash(w) & 0xFFFF for w in want], np.uint64)):
        got = R.by_bytes(windows, raw, s, 3).tolist()
        assert all((x == y) == (a == b) for x, a in zip(got, want) for y, b in zip(got, want))
    assert len(R.by_bytes(np.zeros(0, np.uint64), raw, np.zeros(0, np.int64), 3)) == 0


def test_minhash(spark, docs):
    from gridloom.llm.minhash_dedup import near_duplicates

    assert got(near_duplicates(frame(spark, docs), 4), "n_shingles", "component_id", "kept") == brute.near(docs)
    assert got(near_duplicates(frame(spark, docs), 5, 0.6), "n_shingles", "component_id", "kept") == brute.near(docs, 5, 60)


def test_minhash_of_nothing(spark):
    from gridloom.llm.minhash_dedup import near_duplicates

    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert got(near_duplicates(spark.createDataFrame([(4, None), (2, ""), (9, "a"), (7, "A")], "doc_id long, text string")), "n_shingles", "component_id") == {4: (0, 4), 2: (0, 2), 9: (1, 7), 7: (1, 7)}


def test_minhash_of_equal_and_null_ids_and_clashing_names(spark):
    from gridloom.llm.minhash_dedup import near_duplicates

    words = lambda seed: " ".join(random.Random(seed).choice("abcdefghij") * 3 + str(i) for i in range(60))
    a, b, c = words(1), words(2), words(3)
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (None, c), (7, c + " z"), (8, c), (8, c), (None, "lone")]
    df = spark.createDataFrame([(i, t, "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, stays string, component_id long")
    out = near_duplicates(df, 4, carry=("stays", "component_id"))
    got = {r.component_id_in: (r.doc_id, r.component_id, r.kept, r.stays, r.stays_in) for r in out.collect()}
    assert [got[k][1] for k in range(9)] == [1, 1, 1, 1, 7, 7, 7, 7, None]
    assert [got[k][2] for k in range(9)] == [True, True, False, False, False, True, False, False, True]
    assert [got[k][3] for k in range(9)] == [True, True, False, False, False, True, False, False, True]
    assert all(x[4] == "s" for x in got.values())
    same = near_duplicates(spark.createDataFrame([(4, a), (4, a), (4, a)], "doc_id long, text string")).collect()
    assert sum(r.stays for r in same) == 1 and all(r.kept and r.component_id == 4 for r in same)


def test_minhash_cells_give_every_pair_once():
    from gridloom.llm import arrays as A, minhash_dedup as M

    r = np.random.default_rng(3)
    n, coordinates = 300, 192
    base = r.integers(0, 1 << 32, (6, coordinates), dtype=np.uint64).astype(np.uint32)
    sig = base[np.arange(n) % 6].copy()
    spoil = r.random(sig.shape) < 0.12
    sig[spoil] = r.integers(0, 1 << 32, int(spoil.sum()))
    size = 90 + r.integers(0, 20, n)
    need = 127
    low = sig.astype(np.uint8)
    want = {(i, j) for i in range(n) for j in range(i) if (low[i] == low[j]).sum() >= need and 10 * min(size[i], size[j]) >= 8 * max(size[i], size[j]) and (M.tokens_of(sig[i : i + 1])[0, :3] == M.tokens_of(sig[j : j + 1])[0, :3]).any()}
    import pyarrow as pa

    for blocks in (1, 3):
        token = M.tokens_of(sig)[:, :3].astype(np.int64)
        table = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.arange(n)), pa.array(size), pa.array([x.tobytes() for x in low]), pa.array([bytes(M.PARITY_BITS // 8)] * n), pa.array(token.tolist()), pa.array([[blocks] * 3] * n)], names=list("abcdefg"))
        sent = [x for b in M.deal(A.aligned_keys(4))([table.slice(0, 170), table.slice(170)]) for x in b.to_pylist()]
        pairs = []
        for k in {x["bucket"] for x in sent}:
            mine = pa.RecordBatch.from_pylist([x for x in sent if x["bucket"] == k])
            pairs += [(x["b"], x["a"]) for b in M.meet(coordinates, 0.8, need, 8000, False, 16, 32)([mine]) for x in b.to_pylist()]
        assert set(pairs) == want and len(want) > 500
        trees = []
        for k in {x["bucket"] for x in sent}:
            mine = pa.RecordBatch.from_pylist([x for x in sent if x["bucket"] == k])
            trees += [(x["b"], x["a"]) for b in M.meet(coordinates, 0.8, need, 8000, True, 16, 32)([mine]) for x in b.to_pylist()]
        assert set(trees) <= want and len(trees) <= 4 * n
        joined = M.Forest(np.arange(n)), M.Forest(np.arange(n))
        for forest, links in zip(joined, (trees, sorted(want))):
            forest.edges(*np.array(links).T)
        assert (joined[0].root == joined[1].root).all()


def test_parity_bitmaps_turn_away_no_pair_that_is_alike():
    from gridloom.llm import minhash_dedup as M

    r = np.random.default_rng(5)
    turned = 0
    for size in (1, 3, 10, 100, 900, 6000):
        for _ in range(40):
            a = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
            b = np.unique(np.concatenate((a[r.random(len(a)) > r.random() / 2], r.integers(0, 1 << 63, int(r.integers(0, size // 3 + 1)), dtype=np.uint64))))
            both, n = len(np.intersect1d(a, b)), np.array([len(a), len(b)])
            bits = M.parities(np.concatenate((a, b)), n)
            near = M.could_be_alike(bits[:1], bits[1:], np.array([n.sum()]), 8000)[0]
            assert near or 100 * both < 80 * (n.sum() - both)
            turned += not near
    assert turned > 60


def test_components_of_a_long_chain(spark):
    from gridloom.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (5, 5)], "a long, b long")
    out = {r.id: r.component for r in components(links, "a", "b").collect()}
    assert {out[i] for i in range(1, 41)} == {0} and out[100] == 90


def test_decontamination(spark, docs):
    from gridloom.llm.decontaminate import find_contamination

    texts = [t for _, t in docs if t]
    words = lambda t: brute.NORMAL_WORD.findall(brute.lower(t))
    items = [(10, " / ".join(words(texts[9])[3:20])), (9, texts[12]), (2, "ab cd"), (3, None), (4, "?!"), (5, texts[20].upper()), (6, " ".join(words(texts[30])[:10]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.decontaminate(docs, items)
    cols = ("n_words", F.aggregate("word_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]), F.size("items"), F.sha2(F.array_join("items", ","), 256), F.size("word_spans") > 0)
    assert got(find_contamination(frame(spark, docs), bench), *cols) == want
    assert got(find_contamination(frame(spark, docs), bench, most_bytes=60), *cols) == want  # several automata
    assert find_contamination(frame(spark, docs).limit(0), bench).count() == 0
    assert got(find_contamination(frame(spark, docs), bench.limit(0)), F.size("items")) == {d: (0,) for d, _ in docs}
    for r in find_contamination(frame(spark, docs), bench, carry=("text",)).collect():
        raw = (r.text or "").encode()
        for w, b in zip(r.word_spans, r.byte_spans):
            assert words(raw[b.start : b.end].decode()) == words(r.text)[w.start : w.end]


def test_mixing_of_many_sources_and_odd_rows(spark):
    from gridloom.llm.mixing import mix_sources

    r = random.Random(7)
    names = [f"h{r.randrange(10**6):06}.example" for _ in range(90)] + ["é", "Z", "", None]
    rows = [(i, "w " * (k % 9 * 7 + 1), s) for k, s in enumerate(names) for i in (k, k, 1000 + k)]  # repeated rows, equal sizes
    rows += [(None, "a b", "h"), (5000, None, "empty"), (5001, " \t", "empty"), (5002, "long " * 200_000, "Z")]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, source string, target int, rank int")
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    out = mix_sources(df).collect()
    target = plain_targets(size)
    assert len(out) == len(rows) and all(x.target == pytest.approx(target[x.source]) and x.source_size == size[x.source] for x in out)
    assert all(x.taken == x.size * x.copies and 0 <= x.copies <= 3 for x in out)
    assert sum(x.taken for x in out if x.source == "empty") == 0
    again = mix_sources(df.repartition(3)).collect()
    assert sorted((str(x.doc_id), str(x.source), x.size, x.taken) for x in again) == sorted((str(x.doc_id), str(x.source), x.size, x.taken) for x in out)


CLASHES = ("score", "lang_pred", "n_words", "blk", "carried_0", "items", "kept_text", "row")


def clashing(spark, rows):
    """(id, text) rows with columns named like those that operators make or use."""
    return spark.createDataFrame([(i, t, *(f"{c}-{k}" for c in CLASHES)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES))


def test_columns_carried_never_clash(spark):
    from gridloom.llm.decontaminate import find_contamination
    from gridloom.llm.langid import identify_languages
    from gridloom.llm.minhash_dedup import near_duplicates
    from gridloom.llm.substring_dedup import dedup_substrings
    from gridloom.llm.toxicity import score_toxicity

    rows = [(1, "one two three"), (1, "one two three"), (None, "four five"), (2, None), (3, "")]
    docs = clashing(spark, rows)
    bench = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    for run in (lambda d, c: find_contamination(d, bench, carry=c), lambda d, c: find_contamination(d, bench.union(bench.selectExpr("2L", "'five'")), carry=c, most_bytes=5), lambda d, c: identify_languages(d, {"en": b"one two"}, carry=c), lambda d, c: score_toxicity(d, None, carry=c), lambda d, c: dedup_substrings(d, carry=c), lambda d, c: near_duplicates(d, carry=c)):
        out = run(docs, CLASHES)
        assert len({c.lower() for c in out.columns}) == len(out.columns)
        got = out.toPandas()
        for c in CLASHES:
            back = f"{c}_in" if f"{c}_in" in got else c
            assert sorted(got[back]) == [f"{c}-{k}" for k in range(5)], (c, out.columns)
        assert run(docs.limit(0), CLASHES).count() == 0


def test_language_id_and_toxicity_of_odd_rows(spark):
    from gridloom.llm.langid import identify_languages, train
    from gridloom.llm.toxicity import score_toxicity, train as fit

    long = "ba lo mi " * 100_000
    docs = spark.createDataFrame([(1, "ba lo mi ba lo", "aa"), (1, "ba lo mi ba lo", "aa"), (2, "sch ung keit", "bb"), (3, long, None), (4, "", None), (None, "sch ung", None), (5, "12", None)], "doc_id long, text string, lang string")
    out = identify_languages(docs, train(docs)).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in out) == [("1", "aa"), ("1", "aa"), ("2", "bb"), ("3", "aa"), ("4", "und"), ("5", "und"), ("None", "bb")]
    same = {"xx": b"abc abd", "yy": b"abc abd"}  # a tie goes to the first
    assert {r.lang_pred for r in identify_languages(docs.where("doc_id = 2"), same).collect()} == {"xx"}
    assert identify_languages(docs.limit(0), same).count() == 0
    rows = [(i, "scum words" if i % 4 == 0 else f"good words {i % 5}") for i in range(80)]
    texts = spark.createDataFrame(rows + rows[:8] + [(500, None), (None, "scum"), (501, "good " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(1, 0), (None, 1), (900, 1)], "doc_id long, toxic int")
    model = fit(texts, labels)
    scored = [(r.doc_id, r.score) for r in score_toxicity(texts, model).collect()]
    assert len(scored) == 91 and all((s >= 0.7) == (i is None or i % 4 == 0) for i, s in scored if i is None or i < 80)
    again = fit(texts.repartition(7), labels.repartition(3))
    assert (again.keys == model.keys).all() and np.allclose(again.weights, model.weights)
    assert fit(texts, labels, sample_bytes=5) is None and fit(texts.limit(0), labels) is None and fit(texts, labels.limit(0)) is None
    assert score_toxicity(texts.limit(0), model).count() == 0


PAGE = "<html><head><title>t</title></head><body><nav><a>Menu {0}</a></nav><div class='cookie-notice'>We use {0}</div>{1}<div id=comments><p>nice {0}</p></div><footer>&copy; site {0}</footer></body></html>"


def test_html_extraction(spark):
    from gridloom.llm.html_extract import extract_main_text, main_text

    assert main_text("<article><h1>A &amp; B</h1><p>x\n y<br>z <b>w</b><p>last<script>no()</script></article><aside>no</aside>") == "A & B\n\nx y z w\n\nlast"
    assert main_text("<p>a < b <!-- <p>no --> &lt;c&gt;<ul><li>one<li>two</ul>") == "a < b <c>\n\none\n\ntwo"
    assert main_text("") == "" and main_text("<!DOCTYPE html><html lang='a>b'><style>p{}</style>") == ""
    body = lambda i: f"<div class=story><p>Story {i} of its own.</p></div><div class=boiler><p>All rights of this site are reserved.</p></div>"
    pages = [(i, f"http://a.example/{i}", PAGE.format(i, body(i))) for i in range(8)] + [(8, None, None), (9, "odd", "<p>only</p>"), (9, "odd", "<p>only</p>")]
    out = {(r.page_id, r.text) for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out == {(i, f"Story {i} of its own.") for i in range(8)} | {(8, ""), (9, "only")}


def test_html_markup_of_all_kinds():
    import time

    from gridloom.llm.html_extract import main_text

    assert main_text("<p title=it's>one</p><p>two's</p>") == "one\n\ntwo's"
    assert main_text("<p title='a > b' id=\"x>y\" data-x = z>one</p>") == "one"
    assert main_text('<p title="never closed>one</p><p>two</p>') == "one\n\ntwo"
    assert main_text("<div class='share-price-report'><p>The shares rose.</p></div>") == "The shares rose."
    assert main_text("<article class='story search-results-of-the-expedition'><p>Found.</p></article>") == "Found."
    assert main_text("one <a href=") == "one" and main_text("a <b") == "a" and main_text("a < b") == "a < b" and main_text("</") == "</"
    assert main_text("a<!-- b") == "a" and main_text("a<?php x ?>b</>c") == "abc" and main_text("<p/>a<br/>b<img src=x>c") == "a bc"
    assert main_text("<P CLASS=ad>no<P>yes<DIV HIDDEN>no</DIV>") == "yes"
    words = "word " * 200_000
    assert main_text(f"<article><p>{words}</article>") == words.strip()
    began = time.time()
    for bad in ("<a ", "<a b='", '<a b="', "<!--", "</a", "<head>", "<script>", "<p><b>", "<div>", "<a b=c ", "<p", "& ", "<table><tr><td>"):
        main_text(bad * (400_000 // len(bad)))
    assert time.time() - began < 60


def plain_tree(pages, least_pages=5, least=0.2):
    """Importance of a host's nodes from whole paths and texts: {path: larger entropy}, by the definition."""
    import math
    from collections import Counter
    from xml.etree import ElementTree

    shown, content = {}, {}
    for page in pages:
        here_shown, here_text = {}, {}

        def walk(e, path):
            mine = [t for t in [e.text] if t]
            here_shown.setdefault(path, []).append(tuple(c.tag + c.get("class", "") for c in e))
            for c in e:
                mine += walk(c, f"{path}>{c.tag}.{c.get('class', '')}")
            if mine:
                here_text.setdefault(path, []).extend(mine)
            return mine

        walk(ElementTree.fromstring(page), "body")
        for p, t in here_text.items():
            content.setdefault(p, []).append(tuple(t))
            shown.setdefault(p, []).append(tuple(here_shown[p]))

    def entropy(x):
        n = len(x)
        return -sum(c / n * math.log(c / n) for c in Counter(x).values()) / math.log(n) if n >= least_pages else 1.0

    return {p: max(entropy(shown[p]), entropy(content[p])) for p in content}


def test_html_style_tree_against_a_plain_one(spark):
    from gridloom.llm.html_extract import extract_main_text

    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    pages = []
    for i in range(40):
        parts = [f"<div class='q{k}'>" + "".join(f"<p>{word()}</p>" for _ in range(r.randint(1, 4))) + "</div>" for k in "ab"]  # differ
        parts.insert(1, "<div class='legal'><p>Same words</p><p>on all pages</p></div>")
        parts.append(f"<div class='date'><p>{'Monday' if i % 13 else word()}</p></div>")  # nearly the same on all pages
        parts.append(f"<div class='mood'><p>{r.choice(['good', 'bad', 'fair', 'ill'])}</p></div>")
        if i < 3:
            parts.append("<div class='rare'><p>Same but rare</p></div>")
        pages.append("<body>" + "".join(parts) + "</body>")
    worth = plain_tree(pages)
    low = {p for p, h in worth.items() if h < 0.2}
    assert {"body>div.legal", "body>div.date"} <= low and not {"body>div.qa", "body>div.mood", "body>div.rare"} & low
    from xml.etree import ElementTree

    def text(page):
        out = []
        for d in ElementTree.fromstring(page):
            path = f"body>div.{d.get('class')}"
            out += [p.text for p in d if path not in low and f"{path}>p." not in low]
        return "\n\n".join(out)

    df = spark.createDataFrame([(i, f"https://h.example/{i}", p, "x") for i, p in enumerate(pages)], "page_id long, url string, html string, host string").repartition(3)
    assert {x.page_id: x.text for x in extract_main_text(df).collect()} == {i: text(p) for i, p in enumerate(pages)}
    # a name is not believed where the branch holds most of the text of the host's pages; comments are
    rows = [(i, "https://w.example/", f"<div class='widget'><p>{' '.join(word() for _ in range(30))}</p></div><div class='promo'><p>{word()}</p></div>", "x") for i in range(6)]
    rows += [(10 + i, "https://c.example/", f"<p>{word()}</p><div class='comments'><p>{' '.join(word() for _ in range(30))}</p></div>", "x") for i in range(6)]
    got = {x.page_id: x.text for x in extract_main_text(spark.createDataFrame(rows, df.schema)).collect()}
    assert all(len(got[i].split()) == 30 for i in range(6)) and all(len(got[10 + i].split()) == 1 for i in range(6))
    assert extract_main_text(df.limit(0)).count() == 0


def test_html_names_count_as_a_whole():
    from gridloom.llm.html_extract import main_text

    for start, end in (("<main class='with-sidebar'>", "</main>"), ("<div class='post no-sidebar'>", "</div>"), ("<article class='comments-open'>", "</article>"), ("<main id=search class='widget'>", "</main>"), ("<div class='has-ads menu-open'>", "</div>"), ("<div class='sidebar'><div class=widget><article>", "</article></div></div>"), ("<div class='nav'><main>", "</main></div>")):
        assert main_text(f"<body>{start}<p>Text</p>{end}<div class='ad'>no</div></body>") == "Text", start
    assert main_text("<article><h2 id='related-work'>A</h2><p>b<h2 id='search'>C</h2><section id='search-algorithms'>d</section><section id='search'>e</section><p id='share-prices'>f</p></article>") == "A\n\nb\n\nC\n\nd\n\ne\n\nf"
    for name in ("ad", "ad-slot-3", "cookie-notice", "site-footer", "comment-list", "related_posts", "main-nav", "x sidebar", "social-share-buttons"):
        assert main_text(f"<article><p>Text</p><div class='{name}'>no</div><div id='{name}'>no</div></article>") == "Text" or name == "x sidebar", name
        assert main_text(f"<p>Text</p><div class='{name}'>no</div>") == "Text", name
    assert main_text("<main><article>Text</article><section id=comments><article class=comment>no</article></section></main>") == "Text"
    assert main_text("<article>Text</article><div class=related-posts><article>no</article></div>") == "Text"
    assert main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='application/x-tex'>x=1</annotation></math> be so.</p></article>") == "Let x=1 be so."


def test_language_id(spark):
    from gridloom.llm.langid import Models, identify_languages, suffix_automaton, train

    r = random.Random(3)
    sounds = {"aa": ["ba", "lo", "mi", "tu"], "bb": ["schr", "ung", "keit", "ver"], "cc": ["ção", "ñe", "illa", "é"]}
    text = lambda lang: " ".join("".join(r.choice(sounds[lang]) for _ in range(3)) for _ in range(30))
    rows = [(i, text(k), k) for i, k in enumerate(list(sounds) * 20)]
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 !", None), (902, text("bb"), None)], "doc_id long, text string, lang string")
    samples = train(docs.where("doc_id % 3 <> 7"))
    out = {x.doc_id: (x.lang_pred, x.score) for x in identify_languages(docs, samples).collect()}
    assert all(out[i][0] == k for i, _, k in rows) and out[902][0] == "bb"
    assert out[900] == ("und", 0.0) and out[901] == ("und", 0.0) and all(0 <= s <= 1 for _, s in out.values())
    assert {x.lang_pred for x in identify_languages(docs, train(docs.limit(0))).collect()} == {"und"}
    sample = b"abracadabra banana"
    states = suffix_automaton(sample)
    for piece in (b"cad", b"anan", b"a b"):
        s = 0
        for c in piece:
            s = states[s][c]
    model = Models({"x": sample})

    def plain(t):
        n, i = 0, 0
        while i < len(t):
            j = i + 1
            while j < len(t) and t[i : j + 1] in sample:
                j += 1
            n, i = n + 1, j
        return n

    for t in (b"bananarama", b"zzz", b"abra q cadabra", b""):
        assert model.phrases([t])[0, 0] == plain(t)


def test_language_id_with_samples_of_any_size_and_number(spark):
    from gridloom.llm.langid import Models, identify_languages, train

    r = random.Random(4)
    common = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    words = {k: ["".join(r.choice(common) for _ in range(3)) for _ in range(120)] for k in ("aa", "bb", "cc")}
    text = lambda k, n=40: " ".join(r.choice(words[k]) for _ in range(n))
    rows = [(i, text(k), k) for i, k in enumerate(list(words) * 30)]
    held = [(1000 + i, text(k), None) for i, k in enumerate(list(words) * 20)]
    tiny = [(900, text("aa", 2)[:10], "xx"), (901, "жэ", "yy")]
    docs = spark.createDataFrame(rows + held + tiny, "doc_id long, text string, lang string")
    samples = train(docs)
    assert min(len(samples[k]) for k in words) > 5000 and len(samples["xx"]) == 10
    out = {x.doc_id: x.lang_pred for x in identify_languages(docs, samples).collect()}
    assert all(out[1000 + i] == k for i, k in enumerate(list(words) * 20)) and out[901] == "yy"
    many = spark.createDataFrame([(i, text("aa", 5), f"l{i:03}") for i in range(230)] + [(i, text("bb", 40), "zz") for i in range(300, 340)], "doc_id long, text string, lang string")
    samples = train(many)
    assert len(samples) == 231 and len(samples["zz"]) > 5000
    assert Models(samples).predict([text("bb", 40)])[0] == ["zz"]
    texts = [text(k).encode() for k in words]
    assert (Models(samples, 0, 0).phrases(texts) == Models(samples).phrases(texts)).all()


def test_warc(spark):
    from gridloom.llm.warc import coalesce, fresh_archive, read_warc, write_warc

    rows = [(5, "http://a/1", "<p>é</p>"), (3, "http://a/2\r\nX: y", "<p>é</p>"), (7, None, None), (8, "u", ""), (9, "u", "x\r\n\r\ny"), (9, "u", "x\r\n\r\ny")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = fresh_archive(pages)
    index = write_warc(pages, path)
    out = read_warc(index, path).collect()
    want = brute.warc(rows)
    assert len(out) == len(rows)
    assert {int(r.record_id): (r.payload_bytes, r.digest, r.record_type, r.refers_to and int(r.refers_to)) for r in out} == want
    assert {(r.record_id, bytes(r.payload).decode()) for r in out if r.record_type == "response"} == {("3", "<p>é</p>"), ("7", ""), ("9", "x\r\n\r\ny")}
    assert [r.record_id for r in read_warc(index.where("record_id = '5'"), path).collect()] == ["5"]
    assert coalesce([(0, 5), (5, 5), (100, 1)], 10, 50) == [(0, 10, 2), (100, 101, 1)]
    empty = fresh_archive(pages)
    assert read_warc(write_warc(pages.limit(0), empty), empty).count() == 0


def test_warc_of_clashing_ids_and_odd_urls(spark):
    from gridloom.llm.warc import fresh_archive, read_warc, write_warc

    def back(rows, least=0):
        pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, refers_to int").repartition(2)
        path = fresh_archive(pages)
        return sorted(((r.record_id, r.url, r.record_type, r.refers_to, r.payload_bytes, None if r.payload is None else bytes(r.payload).decode()) for r in read_warc(write_warc(pages, path, least_bytes=least), path).collect()), key=str)

    one = back([(5, "a", "A"), (5, "b", "B"), (3, "c", "A"), (2, "d", "B")])
    assert one == sorted([("5", "a", "revisit", "3", 1, None), ("5", "b", "revisit", "2", 1, None), ("3", "c", "response", None, 1, "A"), ("2", "d", "response", None, 1, "B")], key=str)
    two = back([(5, "a", "A"), (5, "b", "BB"), (3, "c", "A")])
    assert two == sorted([("5", "a", "revisit", "3", 1, None), ("5", "b", "response", None, 2, "BB"), ("3", "c", "response", None, 1, "A")], key=str)
    none = back([(None, "a", "A"), (4, "b", "A"), (None, "c", "C")])
    assert none == sorted([(None, "a", "revisit", "4", 1, None), ("4", "b", "response", None, 1, "A"), (None, "c", "response", None, 1, "C")], key=str)
    urls = ["http://a/\r\nX: y", "urn:none", "", "http://a/%0D", "http://ä b/", None, " x "]
    assert sorted(str(r[1]) for r in back([(i, u, f"p{i}") for i, u in enumerate(urls)])) == sorted(map(str, urls))
    big = "<p>" + "word " * 600_000
    assert [r[4:] for r in back([(1, "u", big)])] == [(len(big), big)]
    assert [r[2] for r in back([(1, "u", "abc"), (2, "u", "abc")], least=10)] == ["response"] * 2


def test_topk(spark):
    from gridloom.llm.topk import top_inner_products

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (1 + i % 7)]) for i in range(230)] + [(300, [0.5] * 8), (301, [0.5] * 8), (302, [0.5] * 8)]
    rows += [(453, []), (454, [1.0]), (455, [9.0, -9.0, 9.0]), (350, [3.0, 2.0]), (100, [0.25] * 8), (7, [50.0] * 8), (7, [50.0] * 8)]  # lengths that differ, and repeated ids
    bad = [(400, None), (450, [float("nan")] * 8), (451, [None] + [1.0] * 7), (452, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    out = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_inner_products(df, lambda v: v % 50 == 0).collect()}
    assert out == brute.topk(rows)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_inner_products(few, lambda v: v % 50 == 0).collect()} == brute.topk(rows[:3])
    blocks = top_inner_products(df, lambda v: v % 50 == 0, query_block=2)
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in blocks.collect()} == out
    assert top_inner_products(df.limit(0), lambda v: v % 50 == 0).count() == 0
    assert top_inner_products(df, lambda v: v < 0).count() == 0


def test_topk_over_many_ranges_and_steps(spark, monkeypatch):
    from gridloom.llm import topk as T

    for name, value in (("HEAD", 20), ("GROWTH", 3), ("CHUNK", 400), ("ROWS", 4), ("STEP", 8)):
        monkeypatch.setattr(T, name, value)
    rng = np.random.default_rng(2)
    turn, c = np.linalg.qr(rng.normal(size=(8, 8)))[0], np.floor(rng.normal(size=(300, 8)) * rng.integers(1, 2000, (300, 1)))
    q, ids = c[:40], rng.permutation(300)
    want = [sorted(((-int(x @ y), i) for y, i in zip(c, ids) if i != j))[:5] for x, j in zip(q, ids)]
    found: dict = {}
    for a in range(0, 300, 90):
        block = T.Candidates(ids[a : a + 90], c[a : a + 90], turn, 2)
        floor = np.array([-sorted(found.get(j, []))[4][0] if len(found.get(j, [])) > 4 else -np.inf for j in ids[:40]], float)
        for who, what, score in zip(*block.search(ids[:40], q, floor, turn, 5, 2)):
            found.setdefault(who, []).append((-score, what))
    assert [sorted(found[j])[:5] for j in ids[:40]] == want
    rows = [(i, [float(x) for x in rng.normal(size=4) * (1 + i % 90)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert len(T.length_bounds(T.whole_vectors(df, "vec_id", "embedding", 256), 400)) > 1
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in T.top_inner_products(df, lambda v: v % 50 == 0, query_block=3).collect()} == brute.topk(rows)


def test_topk_of_huge_numbers(spark):
    from gridloom.llm.topk import top_inner_products

    def of(*rows):
        return {(r.query_id, r.vec_id): r.score for r in top_inner_products(spark.createDataFrame(list(rows), "vec_id long, embedding array<double>"), lambda v: v % 50 == 0).collect()}

    big = 2.0**22 + 3 / 256
    assert of((0, [big, 1.0]), (1, [big, -1.0]), (2, [-big, 2.0**21])) == {(0, 1): int(big * 256) ** 2 - 65536, (0, 2): -(int(big * 256) ** 2) + (1 << 29) * 256}
    for rows in (((0, [1e300, 2.0]), (1, [1.0, 2.0])), ((0, [2.0**40]), (1, [2.0**40]))):
        with pytest.raises(Exception, match="does not fit"):
            of(*rows)


def plain_targets(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not full:
            target |= {s: w[s] * level for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(spark):
    from gridloom.llm.mixing import meet, mix_sources

    r = random.Random(5)
    rows = [(i, "w " * r.randint(0, 40), r.choice(["a", "b", "Z", "é", "tiny", None, "a"])) for i in range(4000)]
    rows = [(i, t if s != "tiny" else "w", s) for i, t, s in rows] + [(9000, None, "empty"), (9001, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(df).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    target = plain_targets(size)
    taken = {}
    for x in out:
        assert x.size == len((rows[x.doc_id][1] if x.doc_id < 9000 else "").split()) and x.source_size == size[x.source]
        assert x.target == pytest.approx(target[x.source]) and 0 <= x.taken <= 3 * x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert len(out) == len(rows)
    for s in size:
        assert abs(taken[s] - target[s]) <= max(60, 0.02 * target[s])
    again = mix_sources(df.repartition(7)).collect()
    assert {x.doc_id: x.taken for x in again} == {x.doc_id: x.taken for x in out}
    draws = [meet(0.3, 0.4, u) for u in np.linspace(0, 1, 2000, endpoint=False)]
    assert np.mean([d[0] for d in draws]) == pytest.approx(0.3, abs=1e-3) and np.mean([d[1] for d in draws]) == pytest.approx(0.4, abs=1e-3)
    draws = [meet(0.8, 0.7, u) for u in np.linspace(0, 1, 2000, endpoint=False)]
    assert np.mean([d[0] for d in draws]) == pytest.approx(0.8, abs=1e-3) and all(1.0 in d for d in draws)
    assert mix_sources(df.limit(0)).count() == 0


def test_toxicity(spark):
    from gridloom.llm.toxicity import score_toxicity, train

    r = random.Random(6)
    clean = ["".join(r.choice("abcdefg") for _ in range(5)) for _ in range(200)]
    rows = []
    for i in range(400):
        w = [r.choice(clean) for _ in range(r.randint(3, 60))]
        bad = i % 4 == 0
        if bad:
            w.insert(r.randrange(len(w)), r.choice(["idiot", "moronic", "moronen", "scum"]))
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    scored = {x.doc_id: x.score for x in score_toxicity(docs, train(docs, labels.where("doc_id % 3 <> 1"))).collect()}
    held = [(y, scored[i]) for i, _, y in rows if i % 3 == 1]
    assert np.mean([(s >= 0.7) == bool(y) for y, s in held]) > 0.97
    assert all(0 <= s <= 1 for s in scored.values()) and scored[900] == scored[901] < 0.5
    assert train(docs, labels.where("toxic = 0")) is None
    assert {x.score for x in score_toxicity(docs, None).collect()} == {0.0}


def test_packed_records():
    from gridloom.llm import arrays as A

    rng = np.random.default_rng(2)
    cols = [rng.integers(0, 1 << 40, 100).astype(np.uint64), rng.integers(-5, 5, 100)]
    back = A.unpack(A.pack(100, [(cols[0], 5), (cols[1], 8)]), [("<u8", 5), ("<i8", 8)])
    assert all((a == b).all() for a, b in zip(cols, back))
    words = [rng.integers(0, 3, 500).astype(np.uint64) for _ in range(3)]
    order = A.multikey_order(words)
    assert list(zip(*(w[order] for w in words))) == sorted(zip(*words))
    assert sorted(A.murmur3_int(A.aligned_keys(13)).astype(np.int64) % 13) == list(range(13))


def test_the_anchors_of_a_block_take_44_bytes_each():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from gridloom.llm import repeats as R

    r = np.random.default_rng(8)
    texts = [r.integers(97, 123, 20_000).astype(np.uint8).tobytes().decode() for _ in range(100)]
    plan = R.Plan(50, 24, False, False, "doc_id", "text")
    docs = R.in_order(pa.table({"doc_id": pa.array(range(100), pa.int64()), "text": texts}), plan)
    R.find(docs, plan)
    tracemalloc.start()
    found = R.find(docs, plan)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    n = len(found.cover)
    assert n > 100_000 and held < 50 * n


def test_tasks_give_their_memory_back(monkeypatch):
    import pyarrow as pa

    from gridloom.llm import arrays as A, minhash_dedup as M

    seen = []
    monkeypatch.setattr(A, "release", lambda: seen.append("released"))
    assert list(A.releasing(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and seen == ["released"]
    texts = ["ab" * 100_000, None, "", "c", "d" * 200_000, "e" * 200_000]
    runs = list(M.text_chunks(pa.array(texts)))
    assert [t for _, _, x in runs for t in x] == [(t or "").encode() for t in texts] and max(sum(map(len, x)) for _, _, x in runs) <= A.CHUNK
    assert [(i, j) for i, j, _ in runs] == [(0, 4), (4, 5), (5, 6)]
