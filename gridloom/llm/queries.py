"""The registered queries of this subpackage. Each goes through its operator and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.suffix_dedup import dedup_suffixes

    out = dedup_suffixes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.substring_dedup import dedup_substrings

    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def crc_third(column: str) -> Column:
    """crc32 of the id as text, modulo 3; null ids count as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(3)), F.lit(0))


HELD_OUT = 1


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.decontaminate import find_contamination

    out = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("word_spans") > 0).alias("contaminated"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.langid import identify_languages, train

    docs = table(spark, sf_dir, "documents")
    samples = train(docs.where(crc_third("doc_id") != HELD_OUT))
    return identify_languages(docs.select("doc_id", "text"), samples).withColumn("held_out", crc_third("doc_id") == HELD_OUT).select("doc_id", "held_out", "lang_pred", "score")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.warc import fresh_archive, read_warc, write_warc

    pages = table(spark, sf_dir, "pages")
    path = fresh_archive(pages)
    out = read_warc(write_warc(pages, path), path, with_payload=False)
    return out.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.topk import top_inner_products

    return top_inner_products(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.toxicity import score_toxicity, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_third("doc_id") != HELD_OUT))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_third("doc_id") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


#: A document is toxic from this score on.
TOXIC = 0.7


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4).drop("stays")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_suffix_dedup, op3_html_extraction, op4_language_id, op5_substring_dedup, op6_warc, op7_exact_topk, op8_source_mixing, op9_toxicity, op10_minhash)}
