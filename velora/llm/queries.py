"""The queries of the thirteen operators, with production parameters, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velora.llm import ball_tree, bpe, collocations, crf, curriculum, jaccard_join, line_dedup, lsh_search, segment_search, substring_dedup, suffix_repeats, toxicity, url_filter

TOKENIZER = "byte_bpe_50k.json"
#: Host, path and verdict of each rule.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(of: int) -> Column:
    """crc32 of doc_id as text, modulo `of`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = crf.fit(docs, remainder(3) != 1)
    out = crf.identify(docs, model, cols=["doc_id"])
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_lsh_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    out = toxicity.score(docs, model, cols=["doc_id"])
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curriculum.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position")


def op11_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_repeats.dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return ball_tree.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_bpe, op3_line_dedup, op4_lsh_search, op5_segment_search, op6_url_filter, op7_jaccard_join, op8_toxicity, op9_substring_dedup, op10_curriculum, op11_suffix_repeats, op12_hard_negatives, op13_collocations)}
