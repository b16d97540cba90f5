"""A corpus pipeline of five stages over `documents`; each stage's output is written as Parquet and is the next one's input.

Defined results of all stages: null and empty texts are neither toxic, nor near-duplicates, nor contaminated, and pass through;
texts of any length are worked on whole; rows of equal ids are documents of their own, as are those of null ids; of repeated rows
near-dedup leaves one; an empty table gives an empty table; all columns of the documents come out as they went in, whatever their
names, but for the text and n_chars that substring dedup cuts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm.decontaminate import find_contamination
from gridloom.llm.minhash_dedup import near_duplicates
from gridloom.llm.mixing import mix_sources
from gridloom.llm.queries import HELD_OUT, TOXIC, crc_third, table
from gridloom.llm.substring_dedup import dedup_substrings
from gridloom.llm.toxicity import score_toxicity, train
from gridloom.session import stored


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns under names that no operator gives or uses, and these by the old ones."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def back(out: DataFrame, names: dict[str, str]) -> DataFrame:
    return out.select(*(F.col(n).alias(c) for c, n in names.items()))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The model learns from labelled documents that are not held out."""
    labels = table(spark, sf_dir, "labels").where(crc_third("doc_id") != HELD_OUT)
    rows, names = apart(docs)
    scored = score_toxicity(rows, train(docs, labels), names["doc_id"], names["text"], carry=tuple(names.values()))
    return back(scored.where(F.col("score") < TOXIC), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that of the least id, and the first of equal ids. Rows have numbers of their own for this."""
    rows, names = apart(docs)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    gone = near_duplicates(rows, id_col=names["doc_id"], text_col=names["text"], carry=("row",)).where(~F.col("stays")).select("row")
    return back(rows.join(stored(gone, "near-duplicates"), "row", "left_anti"), names)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start earlier are cut; documents of which nothing is left go, and untouched ones keep their text as it is."""
    rows, names = apart(docs)
    out = dedup_substrings(rows, id_col=names["doc_id"], text_col=names["text"], carry=tuple(names.values())).where("n_removed < n_words or n_removed = 0")
    cut = F.col("n_removed") > 0
    out = out.withColumn(names["text"], F.when(cut, F.col("kept_text")).otherwise(F.col(names["text"])))
    if "n_chars" in names:
        out = out.withColumn(names["n_chars"], F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(names["n_chars"])))
    return back(out, names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows, names = apart(docs)
    found = find_contamination(rows, table(spark, sf_dir, "benchmark"), id_col=names["doc_id"], text_col=names["text"], carry=tuple(names.values()))
    return back(found.where(F.size("word_spans") == 0), names)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken."""
    return mix_sources(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: A trained score and random rounding have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
