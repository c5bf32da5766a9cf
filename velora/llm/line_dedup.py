"""Operator 3: drop lines that many documents hold.

Lines are exploded with their positions and normalised; a 128-bit hash of each long key is counted
over distinct documents, lines over the threshold go everywhere but in the largest document
holding them, and each text is reassembled from the positions that stay. Built-in functions do all of it.
Only hashes and positions are shuffled for the counts; texts move once, to meet their dropped positions. A line
that a third of all documents hold is pre-aggregated before the shuffle, and the join back on its
hash is left to Spark to split.

Cases: a null or empty text is one empty line, kept. Repeated rows of one doc_id are one document
for the counts, and each is returned; rows without an id count for nothing and lose nothing. Keys
shorter than min_chars never count. Extra columns pass through, whatever their names; n_lines and n_dropped of the input are replaced.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velora.llm.staging import free, staged

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased: of a line in ASCII that is all that lower() does, and faster."""
    key = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def without(lines: Column, gone: Column) -> Column:
    """The elements of lines but for those at the places in gone (ascending, from 0): what lies between two of them is sliced out whole, so
    the work grows with the lines, not with lines times places."""

    def between(own: Column) -> Column:
        edges = F.concat(F.array(F.lit(-1)), own.gone, F.array(F.size(own.lines)))
        cut = lambda e, k: F.slice(e.lines, F.get(e.edges, k) + 2, F.get(e.edges, k + 1) - F.get(e.edges, k) - 1)
        return _let(F.struct(own.lines.alias("lines"), edges.alias("edges")), lambda e: F.flatten(F.transform(F.sequence(F.lit(0), F.size(e.edges) - 2), lambda k: cut(e, k))))

    return _let(F.struct(lines.alias("lines"), gone.alias("gone")), between)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, not anew at each of its uses inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """df's rows with text_col reduced to its kept lines, and n_lines (before) and n_dropped."""
    keep = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    text = F.col(f"`{text_col}`").cast("string")
    # rows that share an id are told apart by their text
    version = F.xxhash64(F.coalesce(text, F.lit("")))
    held = df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), version.alias("version"), F.posexplode(_lines(text)).alias("pos", "line"))
    held = held.where(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    held = staged(held.select("id", "version", "pos", F.unhex(F.md5("key")).alias("key")), "line-keys")
    often = held.select("key", "id").distinct().groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    often = staged(often.where(F.col("n") >= min_docs).select(F.col("key").alias("o_key"), "last"), "line-often")
    gone = held.join(often, F.col("key") == F.col("o_key")).where("id < last").groupBy("id", "version").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    of, l_id, l_version, l_gone = free(df.columns, "l_of", "l_id", "l_version", "l_gone")
    both = df.select(*[F.col(f"`{c}`") for c in keep], version.alias(of))
    both = both.join(gone.toDF(l_id, l_version, l_gone), (F.col(f"`{id_col}`") == F.col(l_id)) & (F.col(of) == F.col(l_version)), "left")
    rest = F.when(F.col(l_gone).isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(without(_lines(text), F.col(l_gone)), "\n"))
    return both.select(
        *[rest.alias(c) if c == text_col else F.col(f"`{c}`") for c in keep],
        F.size(_lines(text)).cast("long").alias("n_lines"),
        F.when(F.col(l_gone).isNull(), 0).otherwise(F.size(l_gone)).cast("long").alias("n_dropped"),
    )
