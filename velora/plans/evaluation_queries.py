"""Queries for text and motion scores, word and name functions, and whole-pose transforms, over stand-ins from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velora.functions import text as T
from velora.functions import vector as V
from velora.operators import corpus, metrics, motion, quantise, sequence
from velora.plans import corpus_queries as Q
from velora.plans import sequence_queries as SQ
from velora.plans import vector_queries as VQ

JOINTS = 3


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return Q._turn_pairs(spark, sf).withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))


def bleu_score(spark, sf):
    return metrics.bleu(_pairs(spark, sf), "k", "gloss", "text").select("pred_len", "ref_len", F.round("bleu", 6).alias("bleu"))


def chrf_score(spark, sf):
    return metrics.chrf(_pairs(spark, sf), "k", "gloss", "text").select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "chrf")])


def label_spread(spark, sf):
    """Twelve labels, of which ten occur."""
    return metrics.conditional_spread(VQ._vectors(spark, sf), "label", "v", "vec_id", 12, 20).select(F.round("multimodality", 6).alias("multimodality"))


def clip_variance(spark, sf):
    return metrics.variance(SQ._frames(spark, sf), ["clip"], "x").select("clip", F.round("variance", 6).alias("variance"))


def valid_error(spark, sf):
    """Mean of values where their whole part isn't the mark."""
    f = SQ._frames(spark, sf).withColumn("mark", F.when(F.floor("x") % 3 == 0, -2.0).otherwise(F.col("x")))
    return f.groupBy("clip").agg(F.round(metrics.valid_mean(F.col("x"), F.col("mark")), 6).alias("error"))


def alphabetic_words(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    return d.select(F.explode(T.alphabetic(T.tokens(F.col("text")))).alias("w")).groupBy(F.char_length("w").alias("length")).agg(F.count("*").alias("n"))


def caption_tokens(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("text is not null")
    c = c.withColumn("t", T.fixed_tokens(F.transform(T.tokens(F.col("text")), lambda w: F.concat(w, F.lit("/X"))), 20))
    return c.select("conv_id", "turn", F.array_join("t.tokens", " ").alias("tokens"), F.col("t.n").alias("n"))


def natural_order(spark, sf):
    """Brands by number, not by digit."""
    b = spark.read.parquet(f"{sf}/part.parquet").select("p_brand").distinct()
    return corpus.placed(b, [T.natural_key(F.col("p_brand"))], "place")


def code_reset(spark, sf):
    v = VQ._vectors(spark, sf)
    book = VQ._codebook(v)
    used = quantise.usage(quantise.nearest(v, book, "vec_id", "v")).where("code % 3 <> 0")
    return quantise.reset(book, used, v, "vec_id", "v").select("code", F.round(F.col("vector")[0], 6).alias("first"))


def acceleration_corpus(spark, sf):
    f = SQ._frames(spark, sf).withColumn("y", F.floor("x").cast("double"))
    return sequence.acceleration_error(f, "x", "y").select(F.round("error", 6).alias("error"))


def quaternion_continuity(spark, sf):
    f = SQ._frames(spark, sf).select("clip", "frame", F.array(F.cos("x"), F.sin("x"), F.lit(0.0), F.lit(0.0)).alias("q"))
    return sequence.continuous(f, "q").select("clip", "frame", F.round(F.col("q")[0], 6).alias("w"), F.round(F.col("q")[1], 6).alias("i"))


def smooth_nearest(spark, sf):
    return sequence.smoothed(SQ._frames(spark, sf), "x", 2.0, nearest=True).select("clip", "frame", F.round("smooth", 6).alias("smooth"))


def _poses(spark, sf):
    """Three joints from a frame's value."""
    x = F.col("x") / 10
    return SQ._frames(spark, sf).select("clip", "frame", F.array(*[F.sin(x * k) + k for k in range(1, 3 * JOINTS + 1)]).alias("pose"))


def joint_map(spark, sf):
    places = motion.matching(["hip", "knee", "foot"], ["ankle", "hip"], {"ankle": "foot"})
    return _poses(spark, sf).select("clip", "frame", F.array_join(F.transform(motion.mapped(F.col("pose"), places), lambda v: F.floor(v * 100).cast("int")), " ").alias("pose"))


def recover_joints(spark, sf):
    """Features of three joints: half turn, step, height, two joints."""
    r = motion.recovered(_poses(spark, sf).withColumn("f", F.concat("pose", F.array(F.lit(1.0)))), JOINTS, features="f")
    return r.select("clip", "frame", *[F.round(F.col("pose")[k], 4).alias(f"p{k}") for k in (0, 1, 2, 3, 5)])


def velocity_features(spark, sf):
    f = motion.velocity_features(_poses(spark, sf).withColumnsRenamed({"pose": "rotations"}).withColumn("place", F.slice("rotations", 1, 3)))
    back = motion.from_velocity(f).select("clip", "frame", F.col("place"))
    return f.join(back, ["clip", "frame"]).select("clip", "frame", F.round(F.col("features")[1], 6).alias("step"), F.round(F.col("place")[0], 6).alias("x"), F.round(F.col("place")[2], 6).alias("height"))


QUERIES = {f.__name__: f for f in (bleu_score, chrf_score, label_spread, clip_variance, valid_error, alphabetic_words, caption_tokens, natural_order, code_reset, acceleration_corpus, quaternion_continuity, smooth_nearest, joint_map, recover_joints, velocity_features)}

_W, _UP = SQ._W, SQ._UP
_BEFORE = "(PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_POSE = f"p AS (SELECT clip, frame, list_transform(range(1, {3 * JOINTS + 1}), lambda k: sin(x / 10 * k) + k) AS pose FROM f)"
_PAIRS = f"{Q._TURNS}, k AS (SELECT conv_id * 1000 + turn AS k, {Q.tokens_sql('gloss')} AS p, {Q.tokens_sql('text')} AS r FROM turns)"


def _side(side: str, n: int) -> str:
    grams = f"list_transform(range(1, length({side}) - {n} + 2), lambda i: substr({side}, i, {n}))"
    return f"(SELECT k, g, count(*) AS n FROM (SELECT k, unnest({grams}) AS g FROM s WHERE length({side}) >= {n}) GROUP BY k, g)"


_CHRF = " UNION ALL ".join(f"SELECT sum(least(a.n, b.n)) AS m, sum(a.n) AS a, sum(b.n) AS b FROM {_side('p', n)} a FULL JOIN {_side('r', n)} b ON a.k = b.k AND a.g = b.g" for n in range(1, 7))
_KEY = "array_to_string(list_transform(regexp_extract_all(p_brand, '([0-9]+|[^0-9]+)'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(CAST(length(regexp_replace(r, '^0+([0-9])', '\\1')) AS VARCHAR), 10, '0') || regexp_replace(r, '^0+([0-9])', '\\1') ELSE r END), '')"

ORACLES = {
    "bleu_score": f"""WITH b AS ({Q._BLEU}), c AS (SELECT n, matched, total, sum(CASE WHEN matched = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS miss FROM b), {_PAIRS},
l AS (SELECT CAST(sum(len(p)) AS BIGINT) AS pred_len, CAST(sum(len(r)) AS BIGINT) AS ref_len FROM k)
SELECT pred_len, ref_len, (SELECT round(CASE WHEN max(matched) = 0 OR min(total) = 0 THEN 0 ELSE 100 * CASE WHEN l.pred_len < l.ref_len THEN exp(1 - l.ref_len / l.pred_len) ELSE 1 END *
  exp(avg(ln(CASE WHEN matched = 0 THEN 1 / pow(2.0, miss) ELSE matched END / total))) END, 6) FROM c) AS bleu FROM l""",
    "chrf_score": f"""WITH {_PAIRS}, s AS (SELECT k, array_to_string(p, '') AS p, array_to_string(r, '') AS r FROM k), n AS ({_CHRF}), m AS (SELECT avg(coalesce(m, 0) / a) AS p, avg(coalesce(m, 0) / b) AS r FROM n WHERE a > 0 AND b > 0)
SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 100 * 5 * p * r / (4 * p + r) ELSE 0 END, 6) AS chrf FROM m""",
    "label_spread": f"""WITH {VQ._V}, r AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place FROM v), n AS (SELECT label, count(*) AS n FROM r GROUP BY label),
d AS (SELECT label, n, unnest(range(0, 20)) AS t FROM n), i AS (SELECT label, CAST(('0x' || substr(md5('first:' || label || ':' || t), 1, 8)) AS BIGINT) % n AS a, CAST(('0x' || substr(md5('second:' || label || ':' || t), 1, 8)) AS BIGINT) % n AS b FROM d)
SELECT round(sum({VQ._L2.format(a='x.v', b='y.v')}) / (20 * 12), 6) AS multimodality FROM i JOIN r x ON x.label = i.label AND x.place = a JOIN r y ON y.label = i.label AND y.place = b""",
    "clip_variance": f"WITH {SQ._F} SELECT clip, round(var_samp(x), 6) AS variance FROM f GROUP BY clip",
    "valid_error": f"WITH {SQ._F} SELECT clip, round(avg(x) FILTER (WHERE CAST(floor(x) AS BIGINT) % 3 <> 0), 6) AS error FROM f GROUP BY clip",
    "alphabetic_words": rf"SELECT CAST(length(w) AS INTEGER) AS length, count(*) AS n FROM (SELECT unnest({Q.tokens_sql('text')}) AS w FROM documents WHERE text IS NOT NULL) WHERE regexp_full_match(w, '\p{{L}}+') GROUP BY 1",
    "caption_tokens": f"""WITH t AS (SELECT conv_id, turn, list_transform({Q.tokens_sql('text')}, lambda w: w || '/X') AS w FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, array_to_string(list_concat(['sos/OTHER'], w[1:20], ['eos/OTHER'], list_transform(range(0, greatest(20 - len(w), 0)), lambda i: 'unk/OTHER')), ' ') AS tokens, CAST(least(len(w), 20) + 2 AS INTEGER) AS n FROM t""",
    "natural_order": f"SELECT p_brand, row_number() OVER (ORDER BY {_KEY}) - 1 AS place FROM (SELECT DISTINCT p_brand FROM part)",
    "code_reset": f"""{VQ._ASSIGN.replace('WITH ', '') if VQ._ASSIGN.startswith('WITH ') else 'WITH ' + VQ._ASSIGN}, used AS (SELECT DISTINCT code FROM near WHERE code % 3 <> 0),
e AS (SELECT code, row_number() OVER (ORDER BY code) AS k FROM book WHERE code NOT IN (SELECT code FROM used)), d AS (SELECT v, row_number() OVER (ORDER BY md5('reset:' || vec_id), vec_id) AS k FROM v)
SELECT book.code, round(coalesce(d.v, b)[1], 6) AS first FROM book LEFT JOIN e ON e.code = book.code LEFT JOIN d ON d.k = e.k""",
    "acceleration_corpus": f"""WITH {SQ._F}, a AS (SELECT clip, abs((lag(x, 2) OVER {_W} - 2 * lag(x, 1) OVER {_W} + x) - (lag(floor(x), 2) OVER {_W} - 2 * lag(floor(x), 1) OVER {_W} + floor(x))) AS a FROM f)
SELECT round(sum(a) / (count(*) - 2 * count(DISTINCT clip)), 6) AS error FROM a""",
    "quaternion_continuity": f"""WITH {SQ._F}, n AS (SELECT *, coalesce(CAST(cos(x) * lag(cos(x)) OVER {_W} + sin(x) * lag(sin(x)) OVER {_W} < 0 AS INTEGER), 0) AS neg FROM f), s AS (SELECT *, CASE WHEN sum(neg) OVER {_UP} % 2 = 1 THEN -1 ELSE 1 END AS s FROM n)
SELECT clip, frame, round(s * cos(x), 6) AS w, round(s * sin(x), 6) AS i FROM s""",
    "smooth_nearest": f"""WITH {SQ._F}, e AS (SELECT clip, max(frame) AS last FROM f GROUP BY clip), k(d, w) AS (VALUES {', '.join(f'({k - 8}, {w / sum(SQ._GAUSS)!r}::DOUBLE)' for k, w in enumerate(SQ._GAUSS))})
SELECT a.clip, a.frame, round(sum(b.x * w), 6) AS smooth FROM f a JOIN e ON a.clip = e.clip CROSS JOIN k JOIN f b ON b.clip = a.clip AND b.frame = least(greatest(a.frame + d, 0), last) GROUP BY a.clip, a.frame""",
    "joint_map": f"WITH {SQ._F}, {_POSE} SELECT clip, frame, array_to_string(list_transform(list_concat(pose[7:9], pose[1:3]), lambda v: CAST(floor(v * 100) AS INTEGER)), ' ') AS pose FROM p",
    "recover_joints": f"""WITH {SQ._F}, {_POSE}, h AS (SELECT *, 2 * coalesce(sum(pose[1]) OVER {_BEFORE}, 0) AS a, coalesce(lag(pose[2]) OVER {_W}, 0) AS vx, coalesce(lag(pose[3]) OVER {_W}, 0) AS vz FROM p),
g AS (SELECT *, sum(vx * cos(a) - vz * sin(a)) OVER {_UP} AS x, sum(vx * sin(a) + vz * cos(a)) OVER {_UP} AS z FROM h)
SELECT clip, frame, round(x, 4) AS p0, round(pose[4], 4) AS p1, round(z, 4) AS p2, round(pose[5] * cos(a) - pose[7] * sin(a) + x, 4) AS p3, round(pose[5] * sin(a) + pose[7] * cos(a) + z, 4) AS p5 FROM g""",
    "velocity_features": f"""WITH {SQ._F}, {_POSE}, s AS (SELECT clip, frame, pose, coalesce(pose[1] - lag(pose[1]) OVER {_W}, 0) AS step FROM p)
SELECT clip, frame, round(step, 6) AS step, round(sum(step) OVER {_UP}, 6) AS x, round(pose[3], 6) AS height FROM s""",
}
