"""Operator 10: mix sources to target weights along a time-varying curriculum.

Each source's weight schedule is integrated over training; its share of the tokens is the integral.
A document's training position is where its source's cumulative token demand reaches the
document's place in the source's own order, found by inverting the integrated schedule. Documents
are then range-sorted by position.

Targets: sources by code point, null last, weigh `weights` in turn and share `factor` times all
sizes; a target stops at `most` times its source's size and the excess is shared again by weight.
That fixed point is reached from below: sources over the common level stop at their limit, which raises the level, until none is over it.
Each step is one sum over the sources, of which there may be many.

A source's order is that of md5(doc_id), then the id, then a digest of the row; rows without an id are placed by a digest of their text. Rows that are alike in all
of these are one row with a count until the mix is planned, so reruns agree whatever the order of rows. Running sums are made in two levels
(256 * 4 buckets of the digest, then rows within a bucket), so that a source with a third of all
rows is spread over many tasks and no task sees a whole source.

Cases: null text or a text without words has size 0 and is never taken. A null source is a source.
Null ids are mixed as others; repeated rows are rows of their own, each with its own part of the target. Extra columns, whatever their names,
don't matter to `mix` and pass through `mixed_documents`. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velora.llm.staging import free, staged
from velora.operators.corpus import placed

WEIGHTS = (3, 1, 2)
FACTOR, MOST = 1.5, 2
#: For the 1st, 2nd and 3rd weight: (time, multiple of the weight) knots from 0 to 1, straight between; each integrates to 1.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)))
BUCKET_BITS = 10


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, factor: float = FACTOR, most: float = MOST) -> DataFrame:
    """(source, source_size, place, target) from rows of (source, size). One row a source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = placed(by, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    by = staged(by.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most))), "mix-sources")
    level, stopped = None, 0
    while True:
        over = F.lit(False) if level is None else F.col("limit") / F.col("weight") <= F.lit(level)
        got = by.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("limit"))).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("free"), F.count(F.when(over, 1)).alias("n")).first()
        if not got.free:  # every source stops at its limit
            target = F.col("limit")
            break
        if level is not None and got.n == stopped:
            target = F.least("limit", F.lit(level) * F.col("weight"))
            break
        level, stopped = ((got["all"] or 0) * float(factor) - (got.held or 0.0)) / got.free, got.n
    return by.select("source", "source_size", "place", target.alias("target"))


def invert(share: Column, knots: tuple) -> Column:
    """Time at which the integral of a piecewise linear schedule, scaled to 1, reaches share (0 to 1)."""
    areas = [(b - a) * (u + v) / 2 for (a, u), (b, v) in zip(knots, knots[1:])]
    total, done, out = sum(areas), 0.0, None
    for ((a, u), (b, v)), area in zip(zip(knots, knots[1:]), areas):
        rest = F.greatest(share * F.lit(total) - F.lit(done), F.lit(0.0))
        slope = (v - u) / (b - a)
        # u t + slope t^2 / 2 = rest, in the form that also holds for a slope of 0
        root = F.sqrt(F.greatest(F.lit(u * u) + F.lit(2 * slope) * rest, F.lit(0.0)))
        at = F.least(F.lit(b), F.lit(a) + F.when(F.lit(u) + root > 0, 2 * rest / (F.lit(u) + root)).otherwise(F.lit(0.0)))
        done += area
        out = F.when(share * F.lit(total) <= F.lit(done), at) if out is None else out.when(share * F.lit(total) <= F.lit(done), at)
    return out.otherwise(F.lit(knots[-1][0]))


def row_digests(df: DataFrame) -> tuple[Column, Column]:
    """128 bits that tell rows apart by all their columns."""
    cols = [F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    return F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)


def _planned(df: DataFrame, id_col: str, text_col: str, source_col: str, digests: tuple[Column, Column], weights: tuple, factor: float, most: float, schedules: tuple) -> DataFrame:
    """One row for each row of df: id, version and check (its digests), repeats (how many rows are like it), size, source_size, target, taken, position, later."""
    m_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    named = F.coalesce(m_id.cast("string"), text, F.lit(""))
    key = F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long")
    rows = df.select(m_id.alias("id"), digests[0].alias("version"), digests[1].alias("check"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(text).alias("size"), key.alias("key"))
    rows = rows.withColumn("bucket", F.shiftright("key", 32 - BUCKET_BITS)).groupBy("source", "bucket", "key", "id", "version", "check", "size").agg(F.count("*").alias("repeats"))
    rows = staged(rows, "mix-sizes")
    words = F.col("size") * F.col("repeats")
    targets = source_targets(rows.select("source", words.alias("size")), weights, factor, most)
    buckets = rows.groupBy("source", "bucket").agg(F.sum(words).alias("in_bucket"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("start", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)))
    plan = staged(buckets.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(F.col("b.source").alias("p_source"), F.col("b.bucket").alias("p_bucket"), "start", "source_size", "place", "target"), "mix-plan")
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("id").asc_nulls_last(), "version", "check", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1))).withColumn("before", F.col("start") + F.col("inside") + F.col("nth") * F.col("size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumn("epochs", epochs).withColumn("over", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    rows = rows.withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", F.col("over") - F.col("before"))))
    share = (F.col("before") + F.col("size") / 2) / F.col("target")
    kinds = len(schedules)
    position = lambda x: F.least(F.lit(1.0), F.coalesce(*[F.when(F.col("place") % kinds == k, invert(F.least(x, F.lit(1.0)), knots)) for k, knots in enumerate(schedules)]))
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, position(share)))
    again = [F.when(F.col("taken") > k * F.col("size"), position(share + k * F.col("source_size") / F.col("target"))) for k in range(1, int(most) + 1)]
    return rows.withColumn("later", F.array_compact(F.array(*again)))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, factor: float = FACTOR, most: float = MOST, schedules: tuple = SCHEDULES) -> DataFrame:
    """One row a document: id_col, size, source_size, target, taken, position, later, sorted by position (never taken: null, last).

    taken is the whole epochs that the target holds, times the size, and of one more epoch the words up to the target;
    position is the training time, 0 to 1, of the first copy, later those of further copies.
    """
    digests = row_digests(df.select(F.col(f"`{text_col}`")))
    rows = _planned(df, id_col, text_col, source_col, digests, weights, factor, most, schedules)
    rows = rows.select(F.col("id").alias(id_col), F.col("size"), "source_size", "target", "taken", "position", "later")
    return rows.orderBy(F.col("position").asc_nulls_last(), id_col)


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, factor: float = FACTOR, most: float = MOST, schedules: tuple = SCHEDULES) -> DataFrame:
    """df's columns, each document as often as the mix takes it (a part of half a document or more counts as one), in order of training position."""
    version, check = row_digests(df)
    planned = _planned(df, id_col, text_col, source_col, (version, check), weights, factor, most, schedules).where("taken > 0")
    copies = F.round(F.col("taken") / F.col("size")).cast("int")
    planned = planned.select("version", "check", "repeats", F.explode(F.slice(F.concat(F.array("position"), F.col("later")), F.lit(1), copies)).alias("position"))
    names = free(df.columns, "m_version", "m_check", "m_position", "m_v", "m_c", "m_r")
    own, same, place, v, c, repeats = names
    plan = staged(planned.select(F.col("version").alias(v), F.col("check").alias(c), F.col("repeats").alias(repeats), F.col("position").alias(place)), "mix-copies")
    rows = df.select(*[F.col(f"`{x}`") for x in df.columns], version.alias(own), check.alias(same))
    meet = (F.col(own) == F.col(v)) & (F.col(same) == F.col(c))
    many = plan.where(F.col(repeats) > 1).select(v, c).distinct()
    if not many.isEmpty():  # the plan names each of the rows that are alike: one of them stands for all
        once = rows.join(many, meet, "left_semi").dropDuplicates([own, same])
        rows = rows.join(many, meet, "left_anti").unionByName(once)
    both = rows.join(plan.drop(repeats), meet)
    return both.orderBy(place, F.col(f"`{id_col}`"), own).select(*[F.col(f"`{x}`") for x in df.columns])
