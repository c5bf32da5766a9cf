"""Queries for retargeting, canonical turns, rotations by angles, caption scores against several references, and errors over parts of clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velora.functions import geometry as G
from velora.functions import vector as V
from velora.operators import metrics, motion, retrieval
from velora.operators import sequence as S
from velora.plans import corpus_queries as Q
from velora.plans import sequence_queries as SQ
from velora.plans import vector_queries as VQ

#: A skeleton of eight joints: spine, two legs of two bones, two shoulders. Directions of the bones at rest, and another body's bones.
CHAINS = [[0, 1, 2], [0, 3, 4], [0, 5, 6], [5, 7]]
DIRECTIONS = [[0, 0, 0], [1, 0, 0], [0, -1, 0], [-1, 0, 0], [0, -1, 0], [0, 1, 0], [1, 0, 0], [-1, 0, 0]]
OFFSETS = [[0, 0, 0], [0.5, 0, 0], [0, -1.5, 0], [-0.5, 0, 0], [0, -1.25, 0], [0, 2.0, 0], [0.75, 0, 0], [-0.625, 0, 0]]
LEG = (3, 4)
BODY = motion.Body(left_hip=1, right_hip=3, left_shoulder=6, right_shoulder=7)


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    """A pose of eight joints from each vector; vectors of one label are a clip, in order of their ids."""
    v = VQ._vectors(spark, sf)
    return v.select(F.col("label").alias("clip"), F.col("vec_id").alias("frame"), F.slice("v", 1, 24).alias("pose"))


def retarget(spark, sf):
    """Each clip on another body: where the root is, how long its bones are, and where its foot's bone points."""
    out = motion.retargeted(_bodies(spark, sf), DIRECTIONS, OFFSETS, CHAINS, LEG, body=BODY)
    at = lambda k, a: F.element_at("pose", 3 * k + a + 1)
    bone = lambda b, a: F.sqrt(sum(((at(b, i) - at(a, i)) ** 2 for i in (1, 2)), (at(b, 0) - at(a, 0)) ** 2))
    total = sum((bone(b, a) for a, b in motion._chain_ends(CHAINS)), F.lit(0.0))
    return out.select("clip", "frame", F.round(at(0, 0), 6).alias("root_x"), F.round(at(0, 2), 6).alias("root_z"), F.round(total, 6).alias("bones"), F.round(bone(4, 3), 6).alias("shin"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """A place and two joints' rotations, as axes times angles, from each vector."""
    v = VQ._vectors(spark, sf)
    return v.select(F.col("label").alias("clip"), F.col("vec_id").alias("frame"), F.slice("v", 1, 3).alias("place"), F.transform(F.slice("v", 4, 6), lambda x: 2 * x).alias("rotations"))


def canonical_turn(spark, sf):
    """Clips turned to one heading: the place, and the steps from frame to frame, whose lengths no turn changes."""
    out = motion.canonical_turn(_turns(spark, sf), kind="axis_angle")
    f = motion.velocity_features(out)
    step = F.sqrt(F.col("features")[1] ** 2 + F.col("features")[2] ** 2)
    steps = f.select(F.col("clip").alias("s_clip"), F.col("frame").alias("s_frame"), step.alias("step"))
    out = out.join(steps, (F.col("clip") == F.col("s_clip")) & (F.col("frame") == F.col("s_frame")))
    return out.select("clip", "frame", *[F.round(F.col("place")[k], 6).alias(f"p{k}") for k in range(3)], F.round("turn", 6).alias("turn"), F.round("step", 6).alias("step"))


def turn_round_trip(spark, sf):
    """Rotations of the root after the turn and its inverse."""
    back = motion.turned_back(motion.canonical_turn(_turns(spark, sf), kind="axis_angle"), kind="axis_angle")
    return back.select("clip", "frame", *[F.round(F.col("place")[k], 8).alias(f"p{k}") for k in range(3)], *[F.round(F.col("rotations")[k], 6).alias(f"r{k}") for k in (0, 1, 2, 5)])


def euler_angles(spark, sf):
    """Angles that turns about x, y and z come back as, and those of the same rotation about z, x and z."""
    angles = VQ._vectors(spark, sf).select("vec_id", F.transform(F.slice("v", 1, 3), lambda x: 8 * x).alias("a"))
    m = angles.withColumn("m", G.euler_to_matrix(F.col("a"), "XYZ"))
    m = m.withColumn("xyz", G.matrix_to_euler(F.col("m"), "XYZ")).withColumn("zxz", G.matrix_to_euler(F.col("m"), "ZXZ"))
    return m.select("vec_id", *[F.round(F.col(o)[k], 6).alias(f"{o}{k}") for o in ("xyz", "zxz") for k in range(3)])


def rotation_values(spark, sf):
    """A rotation vector as a matrix, as six values and as a quaternion."""
    v = VQ._vectors(spark, sf).select("vec_id", F.transform(F.slice("v", 1, 3), lambda x: 6 * x).alias("a"))
    v = v.withColumn("q", G.axis_angle_to_q(F.col("a"))).withColumn("m", G.to_matrix("axis_angle", F.col("a"))).withColumn("six", G.matrix_to("six", F.col("m")))
    return v.select("vec_id", *[F.round(F.col("m")[k], 6).alias(f"m{k}") for k in (0, 1, 2, 3, 5, 7, 8)], F.round(F.col("six")[4], 6).alias("s4"), *[F.round(F.col("q")[k], 6).alias(f"q{k}") for k in range(4)])


def cider(spark, sf):
    """The first turn of each conversation as a caption of it, all later turns as references."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("text is not null").select("conv_id", "turn", "text")
    first = c.groupBy(F.col("conv_id").alias("f_id")).agg(F.min("turn").alias("first"))
    c = c.join(first, F.col("conv_id") == F.col("f_id"))
    scores = metrics.cider(c.where("turn = first"), c.where("turn > first"), "conv_id", "turn", "text")
    return scores.select("id", F.round("cider", 5).alias("cider"))


def ade_between(spark, sf):
    """Mean and last distance over the middle of a clip, between the signal and its frame before."""
    f = SQ._frames(spark, sf).withColumn("d", F.abs(F.col("x") - F.lag("x").over(S.over())))
    return metrics.span_error(f, "clip", "frame", "d", "between", 0.25).select("clip", F.round("ade", 6).alias("ade"), F.round("fde", 6).alias("fde"))


def spread_quotas(spark, sf):
    """Diversity of all rows and of equal numbers of pairs within each of twelve labels, of which ten occur."""
    out = metrics.conditional_spread(VQ._vectors(spark, sf), "label", "v", "vec_id", 12, 20, 200)
    return out.select(F.round("diversity", 6).alias("diversity"), F.round("multimodality", 6).alias("multimodality"))


def camera(spark, sf):
    """Where a camera stands that sees eight joints of a vector at places from its other values."""
    v = VQ._vectors(spark, sf)
    image = F.transform(F.slice("v", 25, 16), lambda x: 112 + 100 * x)
    weights = F.transform(F.slice("v", 41, 8), lambda x: F.abs(x))
    t = v.select("vec_id", motion.camera_translation(F.slice("v", 1, 24), image, weights, 1000.0).alias("t"))
    return t.select("vec_id", *[F.round(F.col("t")[k], 4).alias(f"t{k}") for k in range(3)])


def standard_pose(spark, sf):
    """Four joints of a body in another order, with its axes swapped, twice as long, from the clip's first place on."""
    out = motion.standardised(_bodies(spark, sf), [1, 0, 4, 7], axes=(0, 2, 1), signs=(1, 1, -1), scale=2.0)
    return out.select("clip", "frame", *[F.round(F.col("pose")[k], 6).alias(f"p{k}") for k in (0, 1, 2, 5, 6, 10)])


def facing(spark, sf):
    """Which way a body faces, and its softly lowest height, kept within bounds."""
    b = _bodies(spark, sf)
    at = lambda k: motion.joint(F.col("pose"), k)
    ahead = G.forward_direction(at(BODY.right_hip), at(BODY.left_hip), at(BODY.right_shoulder), at(BODY.left_shoulder))
    heights = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.element_at("pose", 3 * k + 2))
    b = b.withColumn("ahead", ahead).withColumn("low", V.soft_min(heights))
    return b.select("clip", "frame", F.round(F.col("ahead")[0], 6).alias("x"), F.round(F.col("ahead")[1], 6).alias("z"), F.round("low", 6).alias("low"), F.round(V.clamp(F.col("low"), -0.2, 0.2), 6).alias("bounded"))


def body_features(spark, sf):
    """What a body's features keep whatever way it faces: how high its root stands over the floor, how long its step was, and how far off a joint is."""
    f = motion.local_features(_bodies(spark, sf), body=motion.Body(BODY.left_hip, BODY.right_hip, BODY.left_shoulder, BODY.right_shoulder, (2, 4)))
    value = lambda k: F.element_at("features", k)
    return f.select("clip", "frame", F.round(value(1), 6).alias("height"), F.round(F.hypot(value(-2), value(-1)), 6).alias("step"), F.round(F.hypot(value(2), value(4)), 6).alias("off"))


def hits_but_some(spark, sf):
    """The five nearest of some vectors, without those of the labels before and after their own, which are excluded one by one."""
    v = VQ._vectors(spark, sf)
    asked = v.where("vec_id % 100 = 0")
    q = asked.select(F.col("vec_id").alias("q"), F.explode(F.array(F.col("label") - 1, F.col("label") + 1)).alias("not"))
    exclude = q.join(v.select(F.col("vec_id").alias("id"), "label"), F.col("label") == F.col("not")).select("q", "id")
    hits = retrieval.search("dense", v.select("vec_id", "v"), asked.select("vec_id", "v"), "vec_id", "vec_id", "v", 5, exclude)
    return hits.select("q", F.col("rank").cast("int").alias("rank"), "id", "score")


QUERIES = {f.__name__: f for f in (camera, standard_pose, facing, body_features, hits_but_some, retarget, canonical_turn, turn_round_trip, euler_angles, rotation_values, cider, ade_between, spread_quotas)}

_V = VQ._V
_BONE = "sqrt((v[{b}+1]-v[{a}+1])**2 + (v[{b}+2]-v[{a}+2])**2 + (v[{b}+3]-v[{a}+3])**2)"
_LEGS = " + ".join(_BONE.format(b=3 * k, a=3 * a) for a, k in motion._chain_ends(CHAINS) if k in LEG)
_FIRST = "(PARTITION BY label ORDER BY vec_id)"
_WANTED = sum(max(map(abs, OFFSETS[k])) for k in LEG)
_LENGTHS = sum(max(map(abs, OFFSETS[b])) for _, b in motion._chain_ends(CHAINS))
_BELOW = "CAST(('0x' || substr(md5('{side}:' || {key} || ':' || t), 1, 8)) AS BIGINT) % n"
_CIDER_GRAMS = "SELECT id, ref, size, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM s, (VALUES (1), (2), (3), (4)) AS orders(k) WHERE len(w) >= k)"
_LOW = "least(v[8], v[14])"  # the lower foot
ORACLES = {
    "camera": f"""WITH {_V}, j AS (SELECT vec_id, abs(v[40 + i]) AS w, v[3 * i - 2] AS x, v[3 * i - 1] AS y, v[3 * i] AS z, 100 * v[23 + 2 * i] AS u, 100 * v[24 + 2 * i] AS s FROM v, range(1, 9) AS r(i)),
e AS (SELECT vec_id, sum(w) AS w, sum(w * u) AS wu, sum(w * s) AS ws, sum(w * (u * u + s * s)) AS q, sum(w * (u * z - 1000 * x)) AS bx, sum(w * (s * z - 1000 * y)) AS by_, sum(w * (u * (u * z - 1000 * x) + s * (s * z - 1000 * y))) AS bz FROM j GROUP BY vec_id),
d AS (SELECT *, (wu * bx / w + ws * by_ / w - bz) / (q - (wu * wu + ws * ws) / w) AS t2 FROM e)
SELECT vec_id, round((bx + wu * t2) / (1000 * w), 4) AS t0, round((by_ + ws * t2) / (1000 * w), 4) AS t1, round(t2, 4) AS t2 FROM d""",
    "standard_pose": f"""WITH {_V}, p AS (SELECT label, vec_id, list_transform([4, 6, 5, 1, 3, 2, 13, 15, 14, 22, 24, 23], lambda k, i: 2 * v[k] * CASE WHEN i % 3 = 0 THEN -1 ELSE 1 END) AS p FROM v), o AS (SELECT *, first_value(p) OVER {_FIRST} AS o FROM p)
SELECT label AS clip, vec_id AS frame, round(p[1] - o[1], 6) AS p0, round(p[2] - o[2], 6) AS p1, round(p[3] - o[3], 6) AS p2, round(p[6] - o[3], 6) AS p5, round(p[7] - o[1], 6) AS p6, round(p[11] - o[2], 6) AS p10 FROM o""",
    "facing": f"""WITH {_V}, h AS (SELECT label, vec_id, v[10] - v[4] + v[22] - v[19] AS ax, v[12] - v[6] + v[24] - v[21] AS az, list_transform(range(0, 8), lambda k: v[3 * k + 2]) AS y FROM v),
l AS (SELECT *, list_min(y) - ln(0.5::DOUBLE + exp(list_min(y) - list_max(y))) AS low FROM h)
SELECT label AS clip, vec_id AS frame, round(-az / sqrt(ax * ax + az * az), 6) AS x, round(ax / sqrt(ax * ax + az * az), 6) AS z, round(low, 6) AS low, round(greatest(least(low, 0.2::DOUBLE), -0.2::DOUBLE), 6) AS bounded FROM l""",
    "body_features": f"""WITH {_V}, l AS (SELECT label, vec_id, v, min({_LOW}) OVER (PARTITION BY label) AS a, max({_LOW}) OVER (PARTITION BY label) AS b, lag(v[1]) OVER {_FIRST} AS x, lag(v[3]) OVER {_FIRST} AS z FROM v)
SELECT label AS clip, vec_id AS frame, round(v[2] - (a - ln(0.5::DOUBLE + exp(a - b))), 6) AS height, round(coalesce(sqrt((v[1] - x) ** 2 + (v[3] - z) ** 2), 0), 6) AS step, round(sqrt((v[4] - v[1]) ** 2 + (v[6] - v[3]) ** 2), 6) AS off FROM l""",
    "hits_but_some": f"""WITH {_V}, s AS (SELECT q.vec_id AS q, c.vec_id AS id, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM v q JOIN v c ON abs(q.label - c.label) <> 1 WHERE q.vec_id % 100 = 0)
SELECT q, CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""",
    "retarget": f"""WITH {_V}, r AS (SELECT label, vec_id, v, {_WANTED}::DOUBLE / first_value({_LEGS}) OVER {_FIRST} AS ratio FROM v)
SELECT label AS clip, vec_id AS frame, round(v[1] * ratio, 6) AS root_x, round(v[3] * ratio, 6) AS root_z, {_LENGTHS}::DOUBLE AS bones, {max(map(abs, OFFSETS[4]))}::DOUBLE AS shin FROM r""",
    "canonical_turn": f"""WITH {_V}, t AS (SELECT label, vec_id, v, first_value(2 * v[6]) OVER {_FIRST} + pi() / 2 AS turn, v[1] - lag(v[1]) OVER {_FIRST} AS dx, v[2] - lag(v[2]) OVER {_FIRST} AS dy FROM v)
SELECT label AS clip, vec_id AS frame, round(v[1] * cos(turn) + v[2] * sin(turn), 6) AS p0, round(v[2] * cos(turn) - v[1] * sin(turn), 6) AS p1, round(v[3], 6) AS p2, round(turn, 6) AS turn, round(coalesce(sqrt(dx * dx + dy * dy), 0), 6) AS step FROM t""",
    "turn_round_trip": f"WITH {_V} SELECT label AS clip, vec_id AS frame, round(v[1], 8) AS p0, round(v[2], 8) AS p1, round(v[3], 8) AS p2, round(2 * v[4], 6) AS r0, round(2 * v[5], 6) AS r1, round(2 * v[6], 6) AS r2, round(2 * v[9], 6) AS r5 FROM v",
    "euler_angles": f"""WITH {_V}, a AS (SELECT vec_id, sin(8 * v[1]) AS sa, cos(8 * v[1]) AS ca, sin(8 * v[2]) AS sb, cos(8 * v[2]) AS cb, sin(8 * v[3]) AS sc, cos(8 * v[3]) AS cc FROM v)
SELECT vec_id, round(atan2(sa * cb, ca * cb), 6) AS xyz0, round(asin(sb), 6) AS xyz1, round(atan2(cb * sc, cb * cc), 6) AS xyz2,
  round(atan2(sb, sa * cb), 6) AS zxz0, round(acos(ca * cb), 6) AS zxz1, round(atan2(sa * sc - ca * sb * cc, sa * cc + ca * sb * sc), 6) AS zxz2 FROM a""",
    "rotation_values": f"""WITH {_V}, a AS (SELECT vec_id, 6 * v[1] AS x, 6 * v[2] AS y, 6 * v[3] AS z FROM v), n AS (SELECT *, sqrt(x * x + y * y + z * z) AS t FROM a),
k AS (SELECT vec_id, x / t AS x, y / t AS y, z / t AS z, sin(t) AS s, cos(t) AS c, sin(t / 2) AS h, cos(t / 2) AS w FROM n)
SELECT vec_id, round(c + x * x * (1 - c), 6) AS m0, round(x * y * (1 - c) - z * s, 6) AS m1, round(x * z * (1 - c) + y * s, 6) AS m2, round(x * y * (1 - c) + z * s, 6) AS m3, round(y * z * (1 - c) - x * s, 6) AS m5,
  round(y * z * (1 - c) + x * s, 6) AS m7, round(c + z * z * (1 - c), 6) AS m8, round(c + y * y * (1 - c), 6) AS s4, round(w, 6) AS q0, round(x * h, 6) AS q1, round(y * h, 6) AS q2, round(z * h, 6) AS q3 FROM k""",
    "cider": f"""WITH s AS (SELECT conv_id AS id, turn AS ref, {Q.tokens_sql('text')} AS w, len({Q.tokens_sql('text')}) AS size, turn = min(turn) OVER (PARTITION BY conv_id) AS pred FROM conversations WHERE text IS NOT NULL),
g AS ({_CIDER_GRAMS.replace('SELECT id, ref, size, k', 'SELECT id, ref, pred, k', 1)}), tf AS (SELECT id, ref, pred, k, g, count(*) AS tf FROM g GROUP BY ALL),
d AS (SELECT k, g, count(DISTINCT id) AS df FROM tf WHERE NOT pred GROUP BY ALL), n AS (SELECT count(DISTINCT id) AS sets FROM s WHERE NOT pred),
w AS (SELECT tf.id, ref, pred, tf.k, tf.g, tf * (ln((SELECT sets FROM n)) - ln(greatest(coalesce(df, 1), 1))) AS weight FROM tf LEFT JOIN d ON d.k = tf.k AND d.g = tf.g),
l AS (SELECT id, ref, pred, k, sqrt(sum(weight * weight)) AS len FROM w GROUP BY ALL),
c AS (SELECT a.id, b.ref, a.k, sum(least(a.weight, b.weight) * b.weight) AS common FROM w a JOIN w b ON a.id = b.id AND a.k = b.k AND a.g = b.g WHERE a.pred AND NOT b.pred GROUP BY ALL),
m AS (SELECT c.id, c.ref, sum(CASE WHEN x.len > 0 AND y.len > 0 THEN common / (x.len * y.len) ELSE 0 END) AS cosines FROM c JOIN l x ON x.id = c.id AND x.k = c.k AND x.pred JOIN l y ON y.id = c.id AND y.ref = c.ref AND y.k = c.k AND NOT y.pred GROUP BY ALL)
SELECT p.id, round(10 * avg(coalesce(cosines, 0) * exp(-((p.size - r.size) * (p.size - r.size)) / 72.0::DOUBLE)) / 4, 5) AS cider FROM s p JOIN s r ON p.id = r.id AND p.pred AND NOT r.pred LEFT JOIN m ON m.id = r.id AND m.ref = r.ref GROUP BY p.id""",
    "ade_between": f"WITH {SQ._F}, d AS (SELECT clip, frame, abs(x - lag(x) OVER {SQ._W}) AS d, count(*) OVER (PARTITION BY clip) AS n FROM f) SELECT clip, round(avg(d), 6) AS ade, round(arg_max(d, frame), 6) AS fde FROM d WHERE d IS NOT NULL AND frame >= floor(n * 0.25) AND frame < n - floor(n * 0.25) GROUP BY clip",
    "spread_quotas": f"""WITH {_V}, r AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place, row_number() OVER (ORDER BY vec_id) - 1 AS whole FROM v), n AS (SELECT label, count(*) AS n FROM r GROUP BY label),
i AS (SELECT label, {_BELOW.format(side='first', key='label')} AS a, {_BELOW.format(side='second', key='label')} AS b FROM (SELECT label, n, unnest(range(0, 20)) AS t FROM n)),
j AS (SELECT {_BELOW.format(side='first', key=0)} AS a, {_BELOW.format(side='second', key=0)} AS b FROM (SELECT n, unnest(range(0, 200)) AS t FROM (SELECT count(*) AS n FROM r)))
SELECT (SELECT round(sum({VQ._L2.format(a='x.v', b='y.v')}) / 200, 6) FROM j JOIN r x ON x.whole = a JOIN r y ON y.whole = b) AS diversity,
  (SELECT round(sum({VQ._L2.format(a='x.v', b='y.v')}) / (20 * 12), 6) FROM i JOIN r x ON x.label = i.label AND x.place = a JOIN r y ON y.label = i.label AND y.place = b) AS multimodality""",
}
