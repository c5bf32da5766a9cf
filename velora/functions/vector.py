"""Vector functions over array columns, as JVM-side higher-order expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once, not anew at each of its uses inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def unit(a: Column) -> Column:
    return F.transform(doubles(a), lambda x: x / norm(a))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return F.transform(F.arrays_zip(doubles(x).alias("x"), mean.alias("m"), std.alias("s")), lambda z: (z["x"] - z["m"]) / z["s"])


def restore(x: Column, mean: Column, std: Column) -> Column:
    """The inverse of zscore."""
    return F.transform(F.arrays_zip(doubles(x).alias("x"), mean.alias("m"), std.alias("s")), lambda z: z["x"] * z["s"] + z["m"])


def renormalise(x: Column, mean1: Column, std1: Column, mean2: Column, std2: Column) -> Column:
    """From one set of statistics to another."""
    return zscore(restore(x, mean1, std1), mean2, std2)


def pad(x: Column, size: Column | int, zero: Column | None = None) -> Column:
    """Cut or fill up to size."""
    size = F.lit(size) if isinstance(size, int) else size
    zero = F.lit(0.0) if zero is None else zero
    return F.concat(F.slice(x, F.lit(1), F.least(size, F.size(x))), F.array_repeat(zero, F.greatest(size - F.size(x), F.lit(0))))


def mask(length: Column, size: Column | int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: i < length)


def whole_units(n: Column, unit: int = 4) -> Column:
    """n rounded down to whole units."""
    return F.floor(n / unit) * unit


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def smooth_l1(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d < 1, d * d / 2).otherwise(d - 0.5)


def sequence_loss(pred: Column, ref: Column, n: Column, velocity: float = 0.5) -> Column:
    """Mean smooth L1 over the first n values of two sequences, and with a weight that of their steps; 0 for an empty sequence."""
    steps = lambda x: F.zip_with(F.slice(x, F.lit(2), n - 1), F.slice(x, F.lit(1), n - 1), lambda a, b: a - b)
    first = lambda x: F.slice(x, F.lit(1), n)
    mean = lambda a, b, k: total(F.zip_with(a, b, smooth_l1)) / F.greatest(k, F.lit(1))
    pred, ref = doubles(pred), doubles(ref)
    moved = F.when(n > 1, mean(steps(pred), steps(ref), n - 1)).otherwise(F.lit(0.0))
    return F.when(n > 0, mean(first(pred), first(ref), n) + F.lit(velocity) * moved).otherwise(F.lit(0.0))


def soft_min(x: Column, softness: float = 0.5) -> Column:
    """A smooth minimum of an array: -(M + s ln(sum exp((v - M) / s))) of the negated values, with M their maximum."""
    neg = F.transform(doubles(x), lambda v: -v)
    top = F.array_max(neg)
    low = F.array_min(neg)
    return -(top + F.log(F.lit(softness) + F.exp(low - top)))


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("int"))


def pieces(x: Column, size: int) -> Column:
    """A flat array as rows of size values."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / size).cast("int") - 1), lambda i: F.slice(x, i * size + 1, F.lit(size)))
