"""Choices that look random and are the same in every run: digits of an md5 over a salt and the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digits(salt: str, *key: Column) -> Column:
    """A whole number from 0 to 2**32 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("long")


def below(n: Column | int, salt: str, *key: Column) -> Column:
    """A whole number from 0 to n - 1."""
    return F.pmod(digits(salt, *key), F.lit(n) if isinstance(n, int) else n.cast("long"))


def choice(options: Column, salt: str, *key: Column) -> Column:
    """An element of an array; null if it has none."""
    return F.get(options, below(F.greatest(F.size(options), F.lit(1)), salt, *key).cast("int"))


def crop(x: Column, size: Column | int, salt: str, *key: Column) -> Column:
    """size neighbouring elements from a chosen start; both ends may be reached. Null if there are fewer."""
    size = F.lit(size) if isinstance(size, int) else size.cast("int")
    start = below(F.greatest(F.size(x) - size + 1, F.lit(1)), salt, *key).cast("int")
    return F.when(F.size(x) >= size, F.slice(x, start + 1, size))


def unit_length(n: Column, unit: int, salt: str, *key: Column) -> Column:
    """n in whole units, one unit less for a third of the keys; never below 0."""
    fewer = (below(3, salt, *key) == 2).cast("int")
    return F.greatest(F.floor(n / unit) - fewer, F.lit(0)) * unit


def end_dropped(x: Column, salt: str, *key: Column) -> Column:
    """x without its last or its first element for a third of the keys."""
    short = F.greatest(F.size(x) - 1, F.lit(0))
    cut = F.when(below(2, f"{salt}-end", *key) == 0, F.slice(x, F.lit(1), short)).otherwise(F.slice(x, F.lit(2), short))
    return F.when(below(3, salt, *key) == 2, cut).otherwise(x)


def sampled(df: DataFrame, id_col: str, n: int, salt: str = "sample") -> DataFrame:
    """n rows without replacement, those with the smallest digest of their id."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(salt), F.col(id_col).cast("string"))), id_col).limit(n)


def repeated(df: DataFrame, times: int, name: str = "replica") -> DataFrame:
    """Every row `times` times, numbered from 0."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def segment_lengths(items: Column, segments: Column, salt: str, *key: Column) -> Column:
    """items parted into non-empty segments: the first items of all but the first segment are those with the smallest digests."""
    named = lambda i: F.concat(F.md5(F.concat_ws(":", F.lit(salt), *[k.cast("string") for k in key], i.cast("string"))), F.lit(":"), F.lpad(i.cast("string"), 9, "0"))
    inner = F.when(items > 1, F.transform(F.sequence(F.lit(1), F.greatest(items - 1, F.lit(1))), named)).otherwise(F.array().cast("array<string>"))
    cuts = F.array_sort(F.transform(F.slice(F.array_sort(inner), F.lit(1), segments - 1), lambda s: F.substring(s, 34, 9).cast("int")))
    edges = F.concat(F.array(F.lit(0)), cuts, F.array(items))
    return F.transform(F.sequence(F.lit(1), segments), lambda k: F.get(edges, k) - F.get(edges, k - 1))


def corrupted_spans(length: Column, salt: str, *key: Column, density: float = 0.15, mean: float = 3.0) -> Column:
    """array<struct<start, n>>: the spans of a sequence that are hidden. Of length items, density of them (one at least, one fewer than all at most)
    in as many spans as the mean allows; hidden and shown spans alternate, shown first. Needs two items; null for fewer."""
    hidden = F.least(F.greatest(F.rint(length * F.lit(density)).cast("int"), F.lit(1)), length - 1)
    spans = F.greatest(F.rint(hidden / F.lit(mean)).cast("int"), F.lit(1))
    dark, light = segment_lengths(hidden, spans, f"{salt}-hidden", *key), segment_lengths(length - hidden, spans, f"{salt}-shown", *key)
    both = F.arrays_zip(light.alias("light"), dark.alias("dark"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,n:int>>").alias("out"))

    def step(run: Column, z: Column) -> Column:
        start = run["at"] + z["light"]
        return F.struct((start + z["dark"]).alias("at"), F.concat(run["out"], F.array(F.struct(start.alias("start"), z["dark"].alias("n")))).alias("out"))

    return F.when(length >= 2, F.aggregate(both, begin, step, lambda run: run["out"]))
