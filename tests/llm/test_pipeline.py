"""The pipeline's stages against plain versions, each on its own input."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 7))) for _ in range(500)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, item = text(60), text(14)
    texts = [text(r.randint(30, 120)) for _ in range(240)]
    toxic = [i % 6 == 0 for i in range(240)]
    texts = [f"{t} scum" if bad else t for t, bad in zip(texts, toxic)]
    clean = [i for i in range(240) if not toxic[i]]
    for i in clean[10:16]:
        texts[i] = f"{text(100)} {passage} {text(100)}"
    for i in clean[20:23]:
        texts[i] = f"{text(20)} {item} {text(20)}"
    texts += [texts[clean[30]]] * 3 + [texts[clean[31]] + " end"]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(bad)) for i, bad in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, toxic, passage, item


def test_stages(spark, world):
    import corpus_pipeline as P

    d, rows, toxic, passage, item = world
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stage = dict(P.STAGES)
    assert [k for k, _ in P.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "mixing"]
    one = stage["toxicity"](spark, docs, d)
    assert one.columns == docs.columns
    assert {r.doc_id for r in one.collect()} == {i for i, *_ in rows if not (i < 240 and toxic[i])}
    kept = {i for i, (_, _, k) in brute.near([(r[0], r[1]) for r in rows], 5).items() if k}
    assert {r.doc_id for r in stage["near_dedup"](spark, docs, d).collect()} == kept
    cut = {i: x for i, x in brute.substrings([(r[0], r[1]) for r in rows]).items()}
    three = {r.doc_id: r.text for r in stage["substring_dedup"](spark, docs, d).collect()}
    assert set(three) == {i for i, (n, gone, _) in cut.items() if gone < n or not gone}
    assert all(brute.sha(three[i].encode()) == cut[i][2] for i in three)
    assert sum(passage in t for t in three.values()) == 1
    four = {r.doc_id for r in stage["decontamination"](spark, docs, d).collect()}
    assert four == {i for i, t, *_ in rows if item not in t}
    assert stage["mixing"](spark, docs, d).count() == len(rows)


def test_run(spark, world):
    import corpus_pipeline as P

    d, rows, toxic, _, item = world
    out = {r.doc_id: r for r in P.run(spark, d).collect()}
    assert 150 < len(out) < 210 and not any(i < 240 and toxic[i] for i in out)
    assert all(r.taken <= 3 * r.size for r in out.values())


def test_stages_of_odd_tables(spark, world, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, and columns named like those of operators; and empty tables."""
    import corpus_pipeline as P

    d, rows, *_ = world
    long = " ".join(f"w{i}" for i in range(60_000))
    lone = "some words that stand in no other text of this table at all"
    odd = [(900, None), (901, ""), (902, long), (903, lone), (903, lone), (903, lone + " but here and in some more words"), (None, "a text without an id stays too"), (None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, blk int, row long, kept_text string, Component_ID string, items string"
    docs = spark.createDataFrame([(i, t, "en", None if k % 2 else "s", len(t or ""), f"x{k}", k, k, "t", "c", "i") for k, (i, t) in enumerate(odd)], schema)
    extra = lambda df: sorted((r.score, r.blk, r.row, r.kept_text, r.Component_ID, r.items) for r in df.collect())
    all_ = extra(docs)
    stage = dict(P.STAGES)
    for name in ("toxicity", "substring_dedup", "decontamination"):
        out = stage[name](spark, docs, d)
        assert out.columns == docs.columns, name
        gone = {"toxicity": 0, "decontamination": 0, "substring_dedup": 0}[name]
        assert extra(out) == all_ and len(all_) - gone == 8, name
    out = stage["near_dedup"](spark, docs, d)
    kept = out.collect()
    assert out.columns == docs.columns and len(kept) == 7 and sum(r.text == lone for r in kept) == 1
    assert {r.taken for r in stage["mixing"](spark, docs, d).collect() if r.size == 0} == {0}
    none = docs.limit(0)
    for name, f in P.STAGES:
        assert f(spark, none, d).count() == 0, name
