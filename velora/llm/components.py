"""Connected components of a link table, by spreading smallest labels and jumping pointers. Nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velora.llm.staging import drop, staged, tables

#: Links of one id over which they are dealt to several tasks.
HUB = 1 << 16


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b): component is the smallest id that links reach.

    Each round gives every id the smallest label among its neighbours, then the label of that label; rounds grow with the logarithm of a
    component's diameter for the usual shapes. Where links meet the label of an id that has more than HUB of them, both are dealt out by a salt, so
    that no task gets all links of a hub; the smallest label is then a partial aggregate.
    Null ids and links of an id to itself don't count. An empty table gives an empty result.
    """
    start = tables()
    both = links.select("a", "b").where("a <> b")
    both = staged(both.union(both.select("b", "a")).toDF("u", "v").distinct(), "edges")
    hubs = staged(both.groupBy("v").count().where(F.col("count") > HUB).select(F.col("v").alias("hub"), F.ceil(F.col("count") / HUB).alias("parts")), "hubs")
    salted = not hubs.isEmpty()
    if salted:
        both = both.join(hubs, F.col("v") == F.col("hub"), "left").select("u", "v", F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1).cast("long"))).alias("salt"))
        both = staged(both, "salted-edges")
    edges = tables() - start
    held = tables()
    labels = staged(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("label")), "labels")
    while True:
        old = tables() - held
        given, meet = labels, F.col("v") == F.col("id")
        if salted:
            given = labels.join(hubs, F.col("id") == F.col("hub"), "left").select("id", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)).alias("part"))
            meet &= F.col("salt") == F.col("part")
        near = both.join(given, meet).groupBy("u").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("id") == F.col("u")).select("id", F.col("label").alias("old"), F.least("label", "m").alias("next"))
        jump = labels.select(F.col("id").alias("j"), F.col("label").alias("far"))
        step = step.join(jump, F.col("next") == F.col("j"), "left").select("id", "old", F.least("next", F.coalesce("far", "next")).alias("label"))
        step = staged(step, "labels")
        drop(old)
        labels = step.select("id", "label")
        if step.where("old <> label").isEmpty():
            drop(edges)
            return labels.withColumnRenamed("label", "component")
