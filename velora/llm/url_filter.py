"""Operator 6: allow and block rules over URLs.

Every URL is expanded into host suffixes and path prefixes; each pair is one expression. A short
prefix of the expression's digest is the one key of an equi-join with the rules; of what it finds, the full digest then
confirms the hits, and precedence (the longest rule; block before allow where lengths tie) picks one.

Cases: null url or no `://`: empty host and path, no rule, the default verdict. Repeated rows stay
repeated. An empty table gives an empty result. A repeated rule counts once. Null rule parts count as empty; an empty host fits nothing. Columns of the input that
share a name with an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the join compares first: 32 bits.
SHORT = 8
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", default: str = DEFAULT, short: int = SHORT) -> DataFrame:
    """(id_col, host, path, rule, verdict) for each row of pages; rules: (host, path, verdict).

    Only prefix lengths that some rule has are expanded: an expression of another length can't
    equal a rule. The lengths are at most a URL's length in number, however many rules there are.
    """
    rules = (
        rules.select(F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
        .where((F.col("r_host") != "") & F.col("r_verdict").isNotNull())
        .withColumn("digest", _expression(F.col("r_host"), F.col("r_path")))
        .groupBy("digest", "r_host", "r_path")
        .agg(F.max("r_verdict").alias("r_verdict"))  # block before allow
    )
    # a few integers, at most the longest rule path's length in number
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())
    rules = rules.withColumn("short", F.substring("digest", 1, short))
    urls = pages.select(F.col(id_col).alias("v_id"), host_of(F.col(url_col)).alias("v_host"), path_of(F.col(url_col)).alias("v_path")).withColumn("v_row", F.monotonically_increasing_id())
    parts = F.split("v_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("v_path")), lambda n: F.substring(F.col("v_path"), F.lit(1), n))
    expanded = F.flatten(F.transform("hosts", lambda h: F.transform("paths", lambda p: F.struct(h.alias("h"), p.alias("p")))))
    wide = urls.select("v_id", "v_host", "v_path", "v_row", F.filter(suffixes, lambda h: h != "").alias("hosts"), prefixes.alias("paths"))
    made = wide.select("v_id", "v_host", "v_path", "v_row", F.explode_outer(expanded).alias("e")).withColumn("v_digest", _expression(F.col("e.h"), F.col("e.p"))).withColumn("v_short", F.substring("v_digest", 1, short))
    near = made.join(rules, F.col("v_short") == F.col("short"), "left")  # rules whose short keys clash all come along
    best = F.max(F.when(F.col("v_digest") == F.col("digest"), F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule"))))
    return (
        near.groupBy("v_row")
        .agg(F.first("v_id").alias(id_col), F.first("v_host").alias("host"), F.first("v_path").alias("path"), best.alias("best"))
        .select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )
