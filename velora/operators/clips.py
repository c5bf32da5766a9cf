"""Datasets of clips: motions joined with their captions, whole and in the parts that captions name, filtered by length and ordered.

motions: (clip, motion), motion an array of frames or of codes. captions: (clip, line, caption, tokens, from, to) with times in seconds; 0 and 0 mean the
whole clip. All joins are by clip; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velora.functions.sampling import choice, crop, end_dropped, unit_length
from velora.functions.text import word_of
from velora.operators.corpus import placed

#: Shortest clip, and the length that is too long already.
SHORTEST, TOO_LONG = 40, 200


def listed(df: DataFrame, ids: DataFrame, clip: str = "clip", name: str | None = None) -> DataFrame:
    """Rows whose clip is in a list of ids."""
    wanted = ids.select(F.col(name or ids.columns[0]).alias("_listed"))
    return df.join(wanted, F.col(clip) == F.col("_listed"), "left_semi")


def complete(motions: DataFrame, captions: DataFrame, clip: str = "clip") -> DataFrame:
    """Captions with their clip's motion; clips without either are left out."""
    return captions.join(motions.withColumnRenamed(clip, "_m"), F.col(clip) == F.col("_m")).drop("_m")


def audit(motions: DataFrame, captions: DataFrame, ids: DataFrame, clip: str = "clip") -> DataFrame:
    """One row: how many ids of a list there are, how many are skipped for want of a motion or of a caption, and how many captions have no readable times."""
    wanted = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
    has = lambda df, c: df.select(F.col(clip).alias(f"_{c}")).distinct()
    rows = wanted.join(has(motions, "m"), F.col("_id") == F.col("_m"), "left").join(has(captions, "c"), F.col("_id") == F.col("_c"), "left")
    counts = rows.agg(F.count("*").alias("ids"), F.count_if(F.col("_m").isNull()).alias("without_motion"), F.count_if(F.col("_m").isNotNull() & F.col("_c").isNull()).alias("without_caption"))
    bad = captions.agg(F.count_if(F.col("from").isNull() | F.col("to").isNull()).alias("bad_captions"))
    return counts.join(F.broadcast(bad))  # one row


def fits(n: Column, least: int = SHORTEST, below: int = TOO_LONG) -> Column:
    return (n >= least) & (n < below)


def _is_whole() -> Column:
    return (F.col("from") == 0) & (F.col("to") == 0)


def whole(motions: DataFrame, captions: DataFrame, clip: str = "clip") -> DataFrame:
    """(name, motion, texts): clips with captions of the whole, texts in the order of lines."""
    text = F.struct("line", "caption", "tokens")
    texts = captions.where(_is_whole()).groupBy(F.col(clip).alias("_c")).agg(F.array_sort(F.collect_list(text)).alias("texts"))
    rows = motions.join(texts, F.col(clip) == F.col("_c"))
    return rows.select(F.col(clip).cast("string").alias("name"), "motion", "texts")


def parts(motions: DataFrame, captions: DataFrame, fps: float = 20.0, unit: int = 1, clip: str = "clip") -> DataFrame:
    """(name, motion, texts): for each caption of a part that part, cut at whole frames (or units of codes), named after its clip and times. Empty parts are left out."""
    rows = complete(motions, captions.where(~_is_whole()), clip)
    at = lambda c: (F.col(c) * F.lit(fps) / F.lit(float(unit))).cast("int")
    name = F.format_string("%s_%f_%f", F.col(clip).cast("string"), F.col("from").cast("double"), F.col("to").cast("double"))
    cut = F.slice("motion", at("from") + 1, F.greatest(at("to") - at("from"), F.lit(0)))
    return rows.select(name.alias("name"), cut.alias("motion"), F.array(F.struct("line", "caption", "tokens")).alias("texts")).where(F.size("motion") > 0)


def by_length(df: DataFrame, least: int = 0, name: str = "place") -> DataFrame:
    """Rows in the order of their motion's length, then name, numbered from 0; only those of `least` or more, which is where a pointer into the order would stand."""
    return placed(df, [F.size("motion"), "name"], name).where(F.size("motion") >= least)


def text_motion(motions: DataFrame, captions: DataFrame, fps: float = 20.0, least: int = SHORTEST, below: int = TOO_LONG, clip: str = "clip") -> DataFrame:
    """(name, motion, texts, place): clips that fit with their whole captions, and the parts that fit, shortest first."""
    motions = motions.where(fits(F.size("motion"), least, below))
    both = whole(motions, captions, clip).unionByName(parts(motions, captions, fps, clip=clip).where(fits(F.size("motion"), least, below)))
    return by_length(both)


def token_motion(motions: DataFrame, captions: DataFrame, fps: float = 20.0, unit: int = 4, clip: str = "clip") -> DataFrame:
    """(name, motion, texts) over codes: whole clips and parts in units of codes, whatever their length."""
    return whole(motions, captions, clip).unionByName(parts(motions, captions, fps, unit, clip))


def windows(motions: DataFrame, size: int = 64, salt: str = "window", clip: str = "clip") -> DataFrame:
    """(clip, motion): a window of each clip that has as many frames."""
    return motions.where(F.size("motion") >= size).select(clip, crop(F.col("motion"), size, salt, F.col(clip)).alias("motion"))


def trained(df: DataFrame, unit: int = 4, salt: str = "trim") -> DataFrame:
    """A dataset's rows as a training step sees them: motion cut to whole units from a chosen start, one caption chosen, all captions as words."""
    size = unit_length(F.size("motion"), unit, salt, F.col("name"))
    said = F.transform("texts", lambda t: F.array_join(F.transform(t["tokens"], word_of), " "))
    return df.select("name", choice(F.col("texts"), f"{salt}-caption", F.col("name"))["caption"].alias("caption"), crop(F.col("motion"), size, f"{salt}-start", F.col("name")).alias("motion"), said.alias("all_captions"))


def shortened(df: DataFrame, salt: str = "drop") -> DataFrame:
    """Codes without one end for a third of the rows."""
    return df.withColumn("motion", end_dropped(F.col("motion"), salt, F.col("name")))


def zipped(preds: DataFrame, refs: DataFrame, order: list[str], value: str) -> DataFrame:
    """(place, pred, ref): two tables side by side in their order, as far as the shorter goes."""
    side = lambda df, name: placed(df, order, "_p").select(F.col("_p").alias(f"{name}_at"), F.col(value).alias(name))
    return side(preds, "pred").join(side(refs, "ref"), F.col("pred_at") == F.col("ref_at")).select(F.col("pred_at").alias("place"), "pred", "ref")


def with_vectors(tokens: DataFrame, vectors: DataFrame, classes: DataFrame, token: str = "token", unknown: str = "unk", other: str = "OTHER") -> DataFrame:
    """Tokens (word/POS) with the vector of their word and their word class, that of the word in classes (word, class) before the token's own. A word
    without a vector has that of `unknown` and the class `other`. vectors: (word, vec); one row a word in both. The default is a row of its own in a second, small join."""
    rows = tokens.withColumn("_word", word_of(F.col(token))).withColumn("_pos", F.coalesce(F.get(F.split(token, "/"), F.lit(1)), F.lit(other)))
    known = vectors.select(F.col("word").alias("_w"), F.col("vec").alias("_vec"))
    rows = rows.join(known, F.col("_word") == F.col("_w"), "left")
    rows = rows.join(classes.select(F.col("word").alias("_cw"), F.col("class").alias("_class")), F.col("_word") == F.col("_cw"), "left")
    default = vectors.where(F.col("word") == unknown).agg(F.first("vec").alias("_unk"))
    rows = rows.join(F.broadcast(default))  # one row
    missed = F.col("_w").isNull()
    return rows.withColumn("vec", F.when(missed, F.col("_unk")).otherwise(F.col("_vec"))).withColumn("pos", F.when(missed, other).otherwise(F.coalesce("_class", "_pos"))).drop("_word", "_pos", "_w", "_vec", "_cw", "_class", "_unk")
