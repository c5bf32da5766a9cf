"""Operators on frame-indexed sequences in long form: (clip, frame, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velora.functions.vector import dot


def framed(df: DataFrame, clip: str, order: list[str], name: str = "frame") -> DataFrame:
    """Number each clip's rows from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(clip).orderBy(*order)) - 1)


def over(clip: str = "clip", frame: str = "frame"):
    return Window.partitionBy(clip).orderBy(frame)


def so_far(clip: str = "clip", frame: str = "frame"):
    return over(clip, frame).rowsBetween(Window.unboundedPreceding, 0)


def velocity(x: Column, w, padded: bool = False) -> Column:
    d = x - F.lag(x, 1).over(w)
    return F.coalesce(d, F.lit(0.0)) if padded else d


def acceleration(x: Column, w) -> Column:
    return F.lag(x, 2).over(w) - 2 * F.lag(x, 1).over(w) + x


def displaced_sum(x: Column, w) -> Column:
    """The sum of all values before this one."""
    return F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))


def contact(squared_step: Column, threshold: float) -> Column:
    return (squared_step < threshold).cast("int")


def islands(df: DataFrame, flag: str, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """(clip, segment, first, n): segments that begin where flag is 1."""
    rows = df.withColumn("segment", F.sum(flag).over(so_far(clip, frame)))
    return rows.groupBy(clip, "segment").agg(F.min(frame).alias("first"), F.count("*").alias("n"))


def sentinels(df: DataFrame, mask: str, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """span: the number of the masked span at its first frame, -1 on its other frames, 0 elsewhere."""
    w = over(clip, frame)
    begins = F.when((F.col(mask) == 1) & (F.coalesce(F.lag(mask).over(w), F.lit(0)) == 0), 1).otherwise(0)
    rows = df.withColumn("_begins", begins)
    number = F.sum("_begins").over(so_far(clip, frame))
    return rows.withColumn("span", F.when(F.col("_begins") == 1, number).when(F.col(mask) == 1, -1).otherwise(0)).drop("_begins")


def continuous(df: DataFrame, q: str, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """Quaternions (an array column) with the sign that keeps each near the one before: flipped after an odd number of negative products so far."""
    rows = df.withColumn("_flips", (dot(F.col(q), F.lag(q).over(over(clip, frame))) < 0).cast("int"))
    odd = F.coalesce(F.sum("_flips").over(so_far(clip, frame)), F.lit(0)) % 2 == 1
    return rows.withColumn(q, F.when(odd, F.transform(q, lambda x: -x)).otherwise(F.col(q))).drop("_flips")


def smoothed(df: DataFrame, value: str, sigma: float, truncate: float = 4.0, clip: str = "clip", frame: str = "frame", nearest: bool = False) -> DataFrame:
    """Gaussian weights over neighbouring frames (numbered from 0); beyond the ends zero, or with nearest the values there."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = F.array(*[F.lit(r / sum(raw)) for r in raw])
    near = F.collect_list(F.struct(frame, value)).over(over(clip, frame).rowsBetween(-radius, radius))
    rows = df.withColumn("_near", near)
    part = F.aggregate("_near", F.lit(0.0), lambda a, z: a + z[value] * F.element_at(weights, (z[frame] - F.col(frame) + radius + 1).cast("int")))
    if not nearest:
        return rows.withColumn("smooth", part).drop("_near")
    share = [sum(raw[:k]) / sum(raw) for k in range(radius + 1)]  # of the k outermost weights
    whole = over(clip, frame).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lost = lambda inside: F.element_at(F.array(*map(F.lit, share)), F.greatest(radius - inside, F.lit(0)).cast("int") + 1)
    rows = rows.withColumn("smooth", part).withColumns({"_first": F.first(value).over(whole), "_last": F.last(value).over(whole), "_end": F.max(frame).over(whole)})
    ends = lost(F.col(frame)) * F.col("_first") + lost(F.col("_end") - F.col(frame)) * F.col("_last")
    return rows.withColumn("smooth", F.col("smooth") + ends).drop("_near", "_first", "_last", "_end")


def acceleration_error(df: DataFrame, pred: str, ref: str, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """One row: the sum of the differences of acceleration over all frames but two a clip, as one ratio over all clips."""
    w = over(clip, frame)
    rows = df.withColumn("_a", F.abs(acceleration(F.col(pred), w) - acceleration(F.col(ref), w)))
    by = rows.groupBy(clip).agg(F.sum("_a").alias("a"), F.count("*").alias("n"))
    return by.agg((F.sum("a") / (F.sum("n") - 2 * F.count("*"))).alias("error"))


def every(df: DataFrame, last_rate: float, new_rate: float, frame: str = "frame") -> DataFrame:
    """One frame out of int(last_rate / new_rate)."""
    return df.where(F.col(frame) % int(last_rate / new_rate) == 0)


def upsampled(df: DataFrame, value: str, step: int, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """step frames for each, straight between neighbours; the last frame ends it."""
    rows = df.withColumn("_next", F.lead(value).over(over(clip, frame)))
    ks = F.when(F.col("_next").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(step - 1)))
    rows = rows.withColumn("_k", F.explode(ks))
    alpha = F.col("_k") / F.lit(float(step))
    return rows.select(clip, (F.col(frame) * step + F.col("_k")).alias(frame), (F.coalesce((1 - alpha) * F.col(value) + alpha * F.col("_next"), F.col(value))).alias(value))


def evenly(n: Column, keep: int) -> Column:
    """keep places from 0 to n - 1, equally far apart, halves to even."""
    if keep == 1:
        return F.array(F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda i: F.rint(i * (n - 1) / F.lit(float(keep - 1))).cast("int"))


def bounds(start: Column, end: Column, fps: Column, n: Column) -> tuple[Column, Column]:
    """Frames of a time range in seconds: rounded half to even, inside the clip, at least one."""
    at = lambda t: F.greatest(F.lit(0), F.least(n, F.rint(t * fps).cast("int")))
    lo = at(start)
    return lo, F.greatest(at(end), lo + 1)


#: Frames of a bucket in which frames and ranges meet.
BUCKET = 64


def sliced(frames: DataFrame, ranges: DataFrame, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """Frames inside each range [lo, hi) of their clip; ranges: (r_clip, segment, lo, hi).

    Both sides meet in buckets of BUCKET frames of a clip, and only there are bounds compared: a range goes to the buckets that it touches, so that work grows with what
    is found and a long clip is many keys. Ranges that hold nothing meet nothing."""
    bucket = lambda x: F.floor(x / BUCKET)
    spread = ranges.where(F.col("lo") < F.col("hi")).withColumn("_bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi") - 1))))
    met = (F.col(clip) == F.col("r_clip")) & (bucket(F.col(frame)) == F.col("_bucket"))
    return frames.join(spread, met & (F.col(frame) >= F.col("lo")) & (F.col(frame) < F.col("hi"))).drop("r_clip", "_bucket")
