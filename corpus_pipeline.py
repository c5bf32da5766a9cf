"""The training-data pipeline: five stages from `documents` to token counts and digests.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Null and empty texts, ties, repeated rows, empty tables and extra columns are handled as each stage's and operator's docstring says; extra
columns pass through all stages but the last, whatever their names. The mix repeats a document that it takes twice, so ids repeat after it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velora.llm import bpe, crf, curriculum, jaccard_join, line_dedup
from velora.llm.queries import TOKENIZER, remainder
from velora.llm.staging import drop, free, staged, tables

#: Documents whose best language has a smaller share of the words' posteriors are rejected, as are those without a letter.
LEAST_SHARE = 0.35
#: Near-duplicate stages take five words and a similarity of 0.8.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows a changed text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a letter and a language with LEAST_SHARE of its words' posteriors. Null and empty texts go; repeated rows and
    null ids are judged by their text alone. Without a labelled row to learn from, a text without a letter goes and all others stay."""
    model = crf.fit(docs, remainder(3) != 1)
    lang, score = free(docs.columns, "p_lang", "p_score")
    kept = crf.identify(docs, model, names=(lang, score))
    if model is not None:
        kept = kept.where((F.col(lang) != crf.UNKNOWN) & (F.col(score) >= LEAST_SHARE))
    else:
        kept = kept.where(F.col("text").rlike(r"\p{L}"))
    return kept.select(*_columns(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without lines that many documents hold; n_chars is counted anew. A null text comes out empty. Repeated rows of an id
    count as one document; rows without an id lose nothing."""
    return _measured(line_dedup.dedup_lines(docs)).select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id, null ids last; of repeated rows one. Texts without words all stay."""
    return jaccard_join.one_of_each(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in order of training position: null ids and null sources are mixed as all others, repeated rows are
    rows of their own, texts without words are never taken."""
    return curriculum.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, copies included; a null text is an empty one."""
    return bpe.round_trip(docs, public_tokenizers.path(TOKENIZER), bpe.FEW_KEPT)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: A field's posteriors have no SQL form: tests compare each stage, and the whole, with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Each one's result is written and read again; what a stage read or staged for itself goes once its result is written."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), set()
    for name, stage in STAGES[:-1]:
        before = tables()
        out = stage(spark, docs, sf_dir)
        used = tables() - before
        docs = staged(out, f"pipeline-{name}")
        drop(used | read)
        read = tables() - before
    return STAGES[-1][1](spark, docs, sf_dir)
