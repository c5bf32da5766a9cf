"""Sources and sinks. Everything is read and written by Spark, so any store that Spark knows will do."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

BOM = "﻿"


def candidates(spark: SparkSession, path: str, most: int = 10) -> list[str]:
    """Files near a path that isn't there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    up = at.getParent()
    if up is None or not fs.exists(up):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(up) if s.isFile())[:most]


def _there(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"{path} is not there; near it: {candidates(spark, path)}")


def read_delimited(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """All columns as text; empty stays empty. Tab for .tsv and .txt, else comma; if that gives one column and the other gives more, the other.

    A quoted value may hold line ends, and so each file is one task's; lines=False, for files without such values, lets a large file be parted."""
    _there(spark, path)
    first = "\t" if path.rsplit(".", 1)[-1].lower() in ("tsv", "txt") else ","

    def read(sep: str) -> DataFrame:
        df = spark.read.option("sep", sep).option("header", True).option("inferSchema", False).option("nullValue", "\x00").option("emptyValue", "").option("quote", '"').option("escape", '"').option("multiLine", lines).csv(path)
        df = df.toDF(*[c.lstrip(BOM) for c in df.columns])
        return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])

    df = read(first)
    if len(df.columns) == 1:
        other = read("," if first == "\t" else "\t")
        return other if len(other.columns) > 1 else df
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One object a line, blank lines skipped; missing text fields read as ''."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    df = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    return df.select(*[F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema])


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet table at path, made first if it isn't there. The path should name all parameters and inputs."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_lexicon(lexicon: DataFrame, path: str) -> None:
    """A JSON object a stem: {"stem", "glosses": [{"gloss", "weight"}, ...]}, heaviest first."""
    z = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("k"), "gloss", "weight")))
    lexicon.groupBy("stem").agg(F.transform(z, lambda r: F.struct(r["gloss"].alias("gloss"), r["weight"].alias("weight"))).alias("glosses")).write.mode("overwrite").json(path)


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("stem string, glosses array<struct<gloss:string,weight:long>>").json(path)
    return df.select("stem", F.explode("glosses").alias("g")).select("stem", "g.gloss", "g.weight")


def write_tsv(df: DataFrame, path: str) -> None:
    """Header and tab-separated values without quotes or escapes; tabs and line ends inside values become spaces."""
    flat = [F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"[\t\r\n]", " ") for c in df.columns]
    df.select(*[x.alias(c) for x, c in zip(flat, df.columns)]).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "\u0000").option("emptyValue", "").csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines that aren't empty."""
    from velora.functions.text import strip

    return spark.read.text(path).select(strip(F.col("value")).alias("value")).where("value <> ''")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, raw): whole files, parted at form feeds."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\f", -1)).alias("page", "raw"))


def read_captions(spark: SparkSession, path: str, keep_bad: bool = False) -> DataFrame:
    """(clip, caption, tokens, from, to) of lines caption#tokens#from#to; a bad or missing number is 0, or null with keep_bad, so that bad rows can be
    counted; clip is the file's name."""
    parts = F.split("value", "#")
    read = lambda i: F.expr(f"try_cast(get(split(value, '#'), {i}) AS DOUBLE)")
    number = lambda i: F.nanvl(read(i) if keep_bad else F.coalesce(read(i), F.lit(0.0)), F.lit(0.0))
    clip = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]*$", 1)
    return spark.read.text(path).where(F.trim("value") != "").select(clip.alias("clip"), parts[0].alias("caption"), F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), " ").alias("tokens"), number(2).alias("from"), number(3).alias("to"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(text, features) of lines text or text#path."""
    parts = F.split("value", "#")
    return read_lines(spark, path).select(F.trim(parts[0]).alias("text"), F.trim(F.get(parts, F.lit(1))).alias("features"))


def with_features(prompts: DataFrame, arrays: DataFrame) -> DataFrame:
    """Prompts with the values of the array that they name by its file; null where there is none."""
    named = F.regexp_extract("features", r"([^/]+)\.npy$", 1)
    return prompts.join(arrays.select(F.col("clip").alias("_clip"), "shape", "values"), named == F.col("_clip"), "left").drop("_clip")


TEMPLATE = "map<string, map<string, struct<class: string, input: array<string>, output: array<string>>>>"


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(task, subtask, class, input, output) of a nested JSON object."""
    df = spark.read.text(path, wholetext=True).select(F.from_json("value", TEMPLATE).alias("m"))
    return df.select(F.explode("m").alias("task", "subs")).select("task", F.explode("subs").alias("subtask", "t")).select("task", "subtask", "t.*")


_POINTS = ArrayType(ArrayType(FloatType()))
TIERS = ("pose_keypoints_3d", "hand_left_keypoints_3d", "hand_right_keypoints_3d", "face_keypoints_3d")
_MARK = "array<struct<gloss_id: string, start: double, begin: double, end: double, stop: double>>"


def read_signs(spark: SparkSession, root: str, tiers: tuple[str, ...] = TIERS[:3], fps: float = 30.0) -> DataFrame:
    """(path, segment, gloss, lo, hi, motion): the annotated segments of JSON files below root that hold landmarks and a sign script.

    Tiers are cut to the shortest and joined frame by frame; files that lack a tier, and other JSON files, give no row.
    """
    points = ", ".join(f"{t}: array<array<float>>" for t in tiers)
    schema = f"struct<metadata: struct<video_fps: double>, landmarks: struct<{points}>, sign_script: struct<sign_gestures_both: {_MARK}>>"
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    df = files.select(F.input_file_name().alias("path"), F.from_json("value", schema).alias("r")).where("r.landmarks is not null and r.sign_script is not null")
    cols = [F.col(f"r.landmarks.{t}") for t in tiers]
    for c in cols:
        df = df.where(c.isNotNull() & (F.size(c) > 0))
    n = F.least(*map(F.size, cols)) if len(cols) > 1 else F.size(cols[0])
    frames = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(*[F.get(c, i) for c in cols]))
    df = df.select("path", F.coalesce("r.metadata.video_fps", F.lit(fps)).alias("fps"), frames.alias("frames"), F.posexplode("r.sign_script.sign_gestures_both").alias("segment", "g"))
    from velora.operators.sequence import bounds

    lo, hi = bounds(F.coalesce("g.start", "g.begin"), F.coalesce("g.end", "g.stop"), F.col("fps"), F.size("frames"))
    df = df.select("path", "segment", F.col("g.gloss_id").alias("gloss"), lo.alias("lo"), hi.alias("hi"), "frames")
    return df.select("path", "segment", "gloss", "lo", "hi", F.slice("frames", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("motion")).where(F.size("motion") > 0)


def sign_audit(spark: SparkSession, root: str, tiers: tuple[str, ...] = TIERS[:3]) -> DataFrame:
    """One row: how many JSON files there are below root, how many are skipped for want of landmarks or a script, and how many of the others for want of a tier."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    has = lambda path: F.get_json_object("value", path).isNotNull()
    marked = has("$.landmarks") & has("$.sign_script")
    whole = F.lit(True)
    for t in tiers:
        whole = whole & F.coalesce(F.get_json_object("value", f"$.landmarks.{t}") != "[]", F.lit(False))
    return files.agg(F.count("*").alias("files"), F.count_if(~marked).alias("unmarked"), F.count_if(marked & ~whole).alias("without_tier"))


def fullest_folder(spark: SparkSession, root: str) -> DataFrame:
    """One row: the folder below root with the most JSON files that hold landmarks and a sign script."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    ok = F.get_json_object("value", "$.landmarks").isNotNull() & F.get_json_object("value", "$.sign_script").isNotNull()
    by = files.where(ok).groupBy(F.regexp_extract(F.input_file_name(), r"^(.*)/[^/]+$", 1).alias("folder")).agg(F.count("*").alias("files"))
    return by.agg(F.max_by("folder", F.struct("files", F.col("folder"))).alias("folder"), F.max("files").alias("files"))


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(clip, shape, values) of .npy files; arrays of objects are refused, never unpickled."""

    @F.pandas_udf(StructType([StructField("shape", ArrayType(StringType())), StructField("values", ArrayType(FloatType()))]))
    def parse(content: pd.Series) -> pd.DataFrame:
        arrays = [np.load(io.BytesIO(c), allow_pickle=False) for c in content]
        return pd.DataFrame({"shape": [list(map(str, a.shape)) for a in arrays], "values": [a.astype(np.float32).ravel() for a in arrays]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    df = files.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("clip"), parse("content").alias("a"))
    return df.select("clip", F.col("a.shape").cast("array<int>").alias("shape"), "a.values")


def write_stats(stats: DataFrame, path: str) -> None:
    """One row of arrays and settings as a Parquet table; a ValueError if there isn't just one."""
    if len(stats.limit(2).collect()) != 1:
        raise ValueError("statistics are one row")
    stats.coalesce(1).write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON object a row."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def remaining(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose output doesn't exist yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")
