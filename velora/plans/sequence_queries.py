"""Queries over frame-indexed sequences and token tasks. A user's events in order of time are a clip; an event's value is the signal."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velora.functions import text as T
from velora.functions import vector as V
from velora.operators import metrics
from velora.operators import sequence as S


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("clip"), "ts", "event_id", F.col("value").alias("x"), "event_type")
    return S.framed(e, "clip", ["ts", "event_id"]).select("clip", F.col("frame").cast("int").alias("frame"), "x", "event_type")


_F = "f AS (SELECT user_id AS clip, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame, value AS x, event_type FROM events)"
_W = "(PARTITION BY clip ORDER BY frame)"
_UP = "(PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def velocity(spark, sf):
    return _frames(spark, sf).select("clip", "frame", F.round(S.velocity(F.col("x"), S.over()), 6).alias("v"), F.round(S.velocity(F.col("x"), S.over(), True), 6).alias("v_padded"))


def acceleration_error(spark, sf):
    f = _frames(spark, sf).withColumn("a", S.acceleration(F.col("x"), S.over()))
    return f.groupBy("clip").agg(F.count("a").alias("n"), F.round(F.sum(F.abs("a")) / F.greatest(F.count("*") - 2, F.lit(1)), 6).alias("error"))


def integrate(spark, sf):
    f = _frames(spark, sf).withColumn("s", S.displaced_sum(F.col("x"), S.over()))
    return f.select("clip", "frame", F.round("s", 4).alias("s"))


def rebase_cumsum(spark, sf):
    f = _frames(spark, sf).withColumn("c", F.sum("x").over(S.so_far()))
    return f.select("clip", "frame", F.round(F.col("c") - F.first("c").over(S.so_far()), 4).alias("c"))


def sign_continuity(spark, sf):
    """Flip where the number of sign changes so far is odd."""
    f = _frames(spark, sf).withColumn("y", F.sin("x"))
    f = f.withColumn("neg", F.coalesce((F.col("y") * F.lag("y").over(S.over()) < 0).cast("int"), F.lit(0)))
    return f.select("clip", "frame", F.round(F.when(F.sum("neg").over(S.so_far()) % 2 == 1, -F.col("y")).otherwise(F.col("y")), 6).alias("y"))


def contact_flag(spark, sf):
    step = F.lead("x").over(S.over()) - F.col("x")
    return _frames(spark, sf).select("clip", "frame", F.coalesce(S.contact(step * step, 25.0), F.lit(0)).alias("contact"))


def islands(spark, sf):
    return S.islands(_frames(spark, sf).withColumn("flag", (F.col("event_type") == "click").cast("int")), "flag")


def sentinel_spans(spark, sf):
    return S.sentinels(_frames(spark, sf).withColumn("mask", (F.col("x") > 20).cast("int")), "mask").select("clip", "frame", "span")


def gaussian_smooth(spark, sf):
    return S.smoothed(_frames(spark, sf), "x", 2.0).select("clip", "frame", F.round("smooth", 6).alias("smooth"))


def floor_height(spark, sf):
    low = F.min("x").over(Window.partitionBy("clip"))
    return _frames(spark, sf).select("clip", "frame", F.round(F.col("x") - low, 6).alias("above"))


def subsample(spark, sf):
    return S.every(_frames(spark, sf), 20.0, 5.0).groupBy("clip").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"))


def upsample_lerp(spark, sf):
    return S.upsampled(_frames(spark, sf), "x", 4).select("clip", "frame", F.round("x", 6).alias("x"))


def even_sampling(spark, sf):
    n = _frames(spark, sf).groupBy("clip").agg(F.count("*").cast("int").alias("n"))
    return n.select("clip", F.posexplode(S.evenly(F.col("n"), 8)).alias("k", "at"))


def interval_slice(spark, sf):
    """Frames inside the annotated ranges: one range for each event of a user, its value the start in seconds at 2 frames a second."""
    f = _frames(spark, sf)
    n = f.groupBy("clip").agg(F.count("*").cast("int").alias("n")).withColumnRenamed("clip", "n_clip")
    tags = f.join(n, F.col("clip") == F.col("n_clip"))
    lo, hi = S.bounds(F.col("x"), F.col("x") + 2.25, F.lit(2.0), F.col("n"))
    tags = tags.select(F.col("clip").alias("r_clip"), F.col("frame").alias("segment"), lo.alias("lo"), hi.alias("hi"))
    out = S.sliced(f, tags)
    return out.groupBy("clip", "segment").agg(F.min("lo").alias("lo"), F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"))


def ade_fde(spark, sf):
    """Mean and last distance over the last four fifths of a clip, between the signal and its frame before."""
    f = _frames(spark, sf)
    n = F.count("*").over(Window.partitionBy("clip"))
    d = F.abs(F.col("x") - F.lag("x").over(S.over()))
    rows = f.withColumn("n", n).withColumn("d", d).where((F.col("frame") >= F.floor(F.col("n") * 0.2)) & F.col("d").isNotNull())
    return rows.groupBy("clip").agg(F.round(F.avg("d"), 6).alias("ade"), F.round(F.max_by("d", "frame"), 6).alias("fde"))


def recover_root(spark, sf):
    """Root yaw and position from their velocities: sums shifted by one frame, the step turned by the yaw."""
    f = _frames(spark, sf).withColumn("yaw", S.displaced_sum(F.col("x") / 1000, S.over()))
    step = F.coalesce(F.lag("x").over(S.over()), F.lit(0.0)) / 100
    f = f.withColumn("dx", step * F.cos(2 * F.col("yaw"))).withColumn("dz", step * F.sin(2 * F.col("yaw")))
    return f.select("clip", "frame", F.round("yaw", 6).alias("yaw"), F.round(F.sum("dx").over(S.so_far()), 6).alias("px"), F.round(F.sum("dz").over(S.so_far()), 6).alias("pz"))


def replication_ci(spark, sf):
    """Each day of the week is a replication of the mean value by event type."""
    e = spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type", F.dayofweek("ts").alias("run")).agg(F.avg("value").alias("m"))
    return metrics.interval(e, ["event_type"], "m").select("event_type", F.round("mean", 6).alias("mean"), F.round("ci", 6).alias("ci"))


def loss_mean(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where(~F.isnan("value") & F.col("value").isNotNull())
    return e.groupBy("event_type").agg(F.round(F.sum("value") / F.count("*"), 6).alias("loss"), F.count("*").alias("n"))


#: Classes of words, in order of precedence.
WORD_CLASSES = (
    ("Loc_VIP", ("left", "right", "clockwise", "counterclockwise", "anticlockwise", "forward", "back", "backward", "up", "down", "straight", "curve")),
    ("Body_VIP", ("arm", "chin", "foot", "feet", "face", "hand", "mouth", "leg", "waist", "eye", "knee", "shoulder", "thigh")),
    ("Obj_VIP", ("stair", "dumbbell", "chair", "window", "floor", "car", "ball", "handrail", "baseball", "basketball")),
    ("Act_VIP", ("walk", "run", "swing", "pick", "bring", "kick", "put", "squat", "throw", "hop", "dance", "jump", "turn", "stumble", "stop", "sit", "lift", "lower", "raise", "wash", "stand", "kneel", "stroll", "rub", "bend", "balance", "flap", "jog", "shuffle", "lean", "rotate", "spin", "spread", "climb")),
    ("Desc_VIP", ("slowly", "carefully", "fast", "careful", "slow", "quickly", "happy", "angry", "sad", "happily", "angrily", "sadly")),
)
#: Places of the word classes.
CLASS_PLACES = ("VERB", "NOUN", "DET", "ADP", "NUM", "AUX", "PRON", "ADJ", "ADV", "Loc_VIP", "Body_VIP", "Obj_VIP", "Act_VIP", "Desc_VIP", "OTHER")


def word_class(word, pos):
    """The first special class that lists the word, else its part of speech, else OTHER."""
    out = None
    for name, words in WORD_CLASSES:
        out = F.when(word.isin(*words), name) if out is None else out.when(word.isin(*words), name)
    return out.otherwise(F.when(pos.isin(*CLASS_PLACES), pos).otherwise("OTHER"))


def pos_onehot(spark, sf):
    """Words of part names and event types as word/POS tokens: class, its place, and the one-hot row's sum of places."""
    e = spark.read.parquet(f"{sf}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("w"))
    e = e.select(F.concat("w", F.lit("/"), F.when(F.length("w") > 4, "NOUN").otherwise("XX")).alias("token"))
    c = word_class(T.word_of(F.col("token")), T.pos_of(F.col("token")))
    place = F.array_position(F.array(*map(F.lit, CLASS_PLACES)), c) - 1
    hot = V.one_hot(place, len(CLASS_PLACES))
    return e.groupBy("token", c.alias("class"), place.alias("place"), F.aggregate(hot, F.lit(0), lambda a, x: a + x).alias("ones")).agg(F.count("*").alias("n"))


def _codes(spark, sf):
    """A token sequence for each order: line quantities as codes, in line order."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("z"))
    return rows.select(F.col("l_orderkey").alias("id"), F.transform("z", lambda r: r["q"]).alias("codes"))


_CODES = "codes AS (SELECT l_orderkey AS id, list(CAST(l_quantity AS INTEGER) ORDER BY l_linenumber, CAST(l_quantity AS INTEGER)) AS codes FROM lineitem GROUP BY l_orderkey)"


def token_string_roundtrip(spark, sf):
    c = _codes(spark, sf).withColumn("s", T.motion_string(F.col("codes")))
    return c.select("id", "s", (T.motion_codes(F.col("s")) == F.col("codes")).alias("same"))


def token_fixed_len(spark, sf):
    """Start, codes and end, filled to 9 with 0; longer sequences are cropped at 7 codes."""
    c = _codes(spark, sf)
    body = F.slice("codes", F.lit(1), F.lit(7))
    full = V.pad(F.concat(F.array(F.lit(-1)), body, F.array(F.lit(-2))), 9, F.lit(0))
    return c.select("id", F.array_join(full, ",").alias("tokens"), (F.least(F.size("codes"), F.lit(7)) + 2).alias("n"))


def caption_triple(spark, sf):
    """Exactly three captions: a longer list is cut, a shorter one repeats its first."""
    c = _codes(spark, sf)
    three = F.when(F.size("codes") >= 3, F.slice("codes", 1, 3)).when(F.size("codes") == 2, F.concat("codes", F.slice("codes", 1, 1))).otherwise(F.array_repeat(F.col("codes")[0], 3))
    return c.select("id", F.array_join(three, ",").alias("three"))


#: Tasks with input and output templates.
TASKS = (("t2m", "Generate motion: <Caption_Placeholder>", "<Motion_Placeholder>"), ("len", "Motion of <Frame_Placeholder> frames, <Second_Placeholder> seconds", "<Motion_Placeholder>"), ("pred", "Continue: <Motion_Placeholder_s1>", "<Motion_Placeholder_s2>"), ("mask", "Complete: <Motion_Placeholder_Masked>", "<Motion_Placeholder>"))


def _tasks(spark, sf):
    t = spark.createDataFrame([(k, *x) for k, x in enumerate(TASKS)], "k int, task string, input string, output string")
    return _codes(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(TASKS) - 1)))).join(F.broadcast(t), "k")


def task_cross(spark, sf):
    return _tasks(spark, sf).groupBy("task").agg(F.count("*").alias("n"), F.sum(F.size("codes")).cast("long").alias("codes"))


def template_fill(spark, sf):
    t = _tasks(spark, sf)
    frames = F.size("codes") * 4
    fill = lambda c: T.fill(F.col(c), F.concat(F.lit("order "), F.col("id").cast("string")), F.col("codes"), frames)
    return t.select("id", "task", fill("input").alias("input"), fill("output").alias("output"))


def span_mask(spark, sf):
    """Masked spans of about 15 % in spans of 3: where a seeded digest of the frame's group of three falls below the rate."""
    f = _frames(spark, sf)
    key = F.concat_ws(":", F.lit("span"), "clip", F.floor(F.col("frame") / 3).cast("string"))
    mask = (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(0xFFFFFFFF) < 0.15).cast("int")
    return S.sentinels(f.withColumn("mask", mask), "mask").groupBy("clip").agg(F.sum("mask").alias("masked"), F.max("span").alias("spans"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (velocity, acceleration_error, integrate, rebase_cumsum, sign_continuity, contact_flag, islands, sentinel_spans, gaussian_smooth, floor_height, subsample, upsample_lerp, even_sampling, interval_slice, ade_fde, recover_root, replication_ci, loss_mean, pos_onehot, token_string_roundtrip, token_fixed_len, caption_triple, task_cross, template_fill, span_mask)}

_GAUSS = [math.exp(-0.5 * (k / 2.0) ** 2) for k in range(-8, 9)]
_SPANS = "b AS (SELECT *, CASE WHEN mask = 1 AND coalesce(lag(mask) OVER {w}, 0) = 0 THEN 1 ELSE 0 END AS b FROM m), s AS (SELECT *, CASE WHEN b = 1 THEN sum(b) OVER {u} WHEN mask = 1 THEN -1 ELSE 0 END AS span FROM b)".format(w=_W, u=_UP)
_CLASS = "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(x) for x in ws)}) THEN '{n}'" for n, ws in WORD_CLASSES) + f" WHEN pos IN ({', '.join(repr(x) for x in CLASS_PLACES)}) THEN pos ELSE 'OTHER' END"
_STR = "'<motion_id_512>' || list_reduce(list_transform(codes, lambda c: '<motion_id_' || c || '>'), lambda a, b: a || b) || '<motion_id_513>'"
ORACLES = {
    "velocity": f"WITH {_F} SELECT clip, frame, round(x - lag(x) OVER {_W}, 6) AS v, round(coalesce(x - lag(x) OVER {_W}, 0), 6) AS v_padded FROM f",
    "acceleration_error": f"WITH {_F}, a AS (SELECT clip, lag(x, 2) OVER {_W} - 2 * lag(x, 1) OVER {_W} + x AS a FROM f) SELECT clip, count(a) AS n, round(sum(abs(a)) / greatest(count(*) - 2, 1), 6) AS error FROM a GROUP BY clip",
    "integrate": f"WITH {_F} SELECT clip, frame, round(coalesce(sum(x) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS s FROM f",
    "rebase_cumsum": f"WITH {_F}, c AS (SELECT *, sum(x) OVER {_UP} AS c FROM f) SELECT clip, frame, round(c - first_value(c) OVER {_W}, 4) AS c FROM c",
    "sign_continuity": f"WITH {_F}, y AS (SELECT clip, frame, sin(x) AS y FROM f), n AS (SELECT *, coalesce(CAST(y * lag(y) OVER {_W} < 0 AS INTEGER), 0) AS neg FROM y) SELECT clip, frame, round(CASE WHEN sum(neg) OVER {_UP} % 2 = 1 THEN -y ELSE y END, 6) AS y FROM n",
    "contact_flag": f"WITH {_F} SELECT clip, frame, coalesce(CAST((lead(x) OVER {_W} - x) ** 2 < 25.0 AS INTEGER), 0) AS contact FROM f",
    "islands": f"WITH {_F}, g AS (SELECT clip, frame, CAST(sum(CAST(event_type = 'click' AS INTEGER)) OVER {_UP} AS BIGINT) AS segment FROM f) SELECT clip, segment, min(frame) AS first, count(*) AS n FROM g GROUP BY clip, segment",
    "sentinel_spans": f"WITH {_F}, m AS (SELECT clip, frame, CAST(x > 20 AS INTEGER) AS mask FROM f), {_SPANS} SELECT clip, frame, CAST(span AS BIGINT) AS span FROM s",
    "gaussian_smooth": f"WITH {_F}, k(d, w) AS (VALUES {', '.join(f'({k - 8}, {w / sum(_GAUSS)!r}::DOUBLE)' for k, w in enumerate(_GAUSS))}) SELECT a.clip, a.frame, round(sum(b.x * w), 6) AS smooth FROM f a JOIN f b ON a.clip = b.clip AND b.frame BETWEEN a.frame - 8 AND a.frame + 8 JOIN k ON d = b.frame - a.frame GROUP BY 1, 2",
    "floor_height": f"WITH {_F} SELECT clip, frame, round(x - min(x) OVER (PARTITION BY clip), 6) AS above FROM f",
    "subsample": f"WITH {_F} SELECT clip, count(*) AS n, round(sum(x), 4) AS total FROM f WHERE frame % 4 = 0 GROUP BY clip",
    "upsample_lerp": f"WITH {_F}, n AS (SELECT *, lead(x) OVER {_W} AS nx FROM f), k AS (SELECT *, unnest(CASE WHEN nx IS NULL THEN [0] ELSE [0, 1, 2, 3] END) AS k FROM n) SELECT clip, frame * 4 + k AS frame, round(coalesce((1 - k / 4.0::DOUBLE) * x + k / 4.0::DOUBLE * nx, x), 6) AS x FROM k",
    "even_sampling": f"WITH {_F}, n AS (SELECT clip, count(*) AS n FROM f GROUP BY clip), k AS (SELECT clip, n, unnest(range(0, 8)) AS k FROM n) SELECT clip, CAST(k AS INTEGER) AS k, CAST(round_even(k * (n - 1) / 7.0::DOUBLE, 0) AS INTEGER) AS at FROM k",
    "interval_slice": f"""WITH {_F}, n AS (SELECT clip, count(*) AS n FROM f GROUP BY clip), t AS (SELECT clip, frame AS segment, CAST(greatest(0, least(n, round_even(x * 2, 0))) AS INTEGER) AS lo, CAST(greatest(0, least(n, round_even((x + 2.25) * 2, 0))) AS INTEGER) AS h FROM f JOIN n USING (clip))
SELECT f.clip, segment, min(lo) AS lo, count(*) AS n, round(sum(x), 4) AS total FROM f JOIN t ON f.clip = t.clip AND frame >= lo AND frame < greatest(h, lo + 1) GROUP BY 1, 2""",
    "ade_fde": f"WITH {_F}, d AS (SELECT clip, frame, abs(x - lag(x) OVER {_W}) AS d, count(*) OVER (PARTITION BY clip) AS n FROM f) SELECT clip, round(avg(d), 6) AS ade, round(arg_max(d, frame), 6) AS fde FROM d WHERE d IS NOT NULL AND frame >= floor(n * 0.2) GROUP BY clip",
    "recover_root": f"WITH {_F}, y AS (SELECT *, coalesce(sum(x / 1000) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS yaw, coalesce(lag(x) OVER {_W}, 0) / 100 AS step FROM f) SELECT clip, frame, round(yaw, 6) AS yaw, round(sum(step * cos(2 * yaw)) OVER {_UP}, 6) AS px, round(sum(step * sin(2 * yaw)) OVER {_UP}, 6) AS pz FROM y",
    "replication_ci": "WITH e AS (SELECT event_type, dayofweek(ts) AS run, avg(value) AS m FROM events GROUP BY 1, 2) SELECT event_type, round(avg(m), 6) AS mean, round(1.96 * stddev_pop(m) / sqrt(count(m)), 6) AS ci FROM e GROUP BY 1",
    "loss_mean": "SELECT event_type, round(sum(value) / count(*), 6) AS loss, count(*) AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1",
    "pos_onehot": f"WITH t AS (SELECT w, CASE WHEN length(w) > 4 THEN 'NOUN' ELSE 'XX' END AS pos FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)), c AS (SELECT w || '/' || pos AS token, {_CLASS} AS class FROM t) SELECT token, class, list_position([{', '.join(repr(x) for x in CLASS_PLACES)}], class) - 1 AS place, 1 AS ones, count(*) AS n FROM c GROUP BY 1, 2",
    "token_string_roundtrip": f"WITH {_CODES} SELECT id, {_STR} AS s, true AS same FROM codes",
    "token_fixed_len": f"WITH {_CODES} SELECT id, array_to_string(list_resize(list_concat([-1], codes[1:7], [-2]), 9, 0), ',') AS tokens, CAST(least(len(codes), 7) + 2 AS INTEGER) AS n FROM codes",
    "caption_triple": f"WITH {_CODES} SELECT id, array_to_string(CASE WHEN len(codes) >= 3 THEN codes[1:3] WHEN len(codes) = 2 THEN list_concat(codes, codes[1:1]) ELSE [codes[1], codes[1], codes[1]] END, ',') AS three FROM codes",
    "task_cross": f"WITH {_CODES}, t(task) AS (VALUES {', '.join(f'({t[0]!r})' for t in TASKS)}) SELECT task, count(*) AS n, CAST(sum(len(codes)) AS BIGINT) AS codes FROM codes, t GROUP BY task",
    "span_mask": f"WITH {_F}, m AS (SELECT clip, frame, CAST(CAST(('0x' || substr(md5('span:' || clip || ':' || (frame // 3)), 1, 8)) AS BIGINT) / 4294967295.0 < 0.15 AS INTEGER) AS mask FROM f), {_SPANS} SELECT clip, CAST(sum(mask) AS BIGINT) AS masked, CAST(max(span) AS BIGINT) AS spans, count(*) AS n FROM s GROUP BY clip",
}
