"""Staged tables for operators over long texts: small Arrow batches, and names that clash with no column."""

from __future__ import annotations

from pyspark.sql import DataFrame

from velora.sources import staging as base
from velora.sources.staging import BATCH as _BATCH
from velora.sources.staging import MOST_ROWS, drop, shared_folder, small_batches, tables

__all__ = ["drop", "free", "shared_folder", "small_batches", "staged", "tables"]

#: Rows of an Arrow batch without texts.
NARROW_ROWS = 10_000


def free(columns: list[str], *names: str) -> list[str]:
    """names, each lengthened until no column has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def staged(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """base.staged with small Arrow batches; narrow: the batches that df's plan sends to Python hold no texts."""
    spark = df.sparkSession
    small_batches(spark)
    rows = spark.conf.get(_BATCH)
    if narrow and int(rows) == MOST_ROWS:
        spark.conf.set(_BATCH, NARROW_ROWS)
    try:
        return base.staged(df, name)
    finally:
        spark.conf.set(_BATCH, rows)
