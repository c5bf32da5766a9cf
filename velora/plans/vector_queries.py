"""Queries over vectors: dense retrieval, statistics, quantisation, retrieval and distribution metrics, rotations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from velora.functions import geometry as G
from velora.functions import vector as V
from velora.operators import corpus, metrics, quantise, retrieval

BLOCK = 32


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding is not null").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))


_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)"
_DIMS = "dims AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM v)"
_L2 = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def dense_topk(spark, sf):
    v = _vectors(spark, sf)
    return retrieval.dense_top(v, v.where("vec_id % 100 = 0"), "vec_id", "vec_id", "v", 5)


def _stats(v: DataFrame) -> DataFrame:
    """One row with arrays of means and deviations: as many values as a vector has."""
    m = metrics.moments(v, "v").agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("m"))
    return m.select(F.transform("m", lambda z: z["mean"]).alias("mean"), F.transform("m", lambda z: z["std"]).alias("std"))


def feature_stats(spark, sf):
    m = metrics.moments(_vectors(spark, sf), "v")
    return m.select("dim", "n", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


def zscore(spark, sf):
    v = _vectors(spark, sf)
    z = v.join(F.broadcast(_stats(v))).select("vec_id", V.zscore(F.col("v"), F.col("mean"), F.col("std")).alias("z"))
    return z.select("vec_id", F.round(F.col("z")[0], 6).alias("first"), F.round(V.total(F.transform("z", lambda x: x * x)), 4).alias("energy"))


def renorm(spark, sf):
    v = _vectors(spark, sf)
    a, b = _stats(v.where("label < 5")), _stats(v.where("label >= 5")).withColumnsRenamed({"mean": "mean2", "std": "std2"})
    r = v.join(F.broadcast(a)).join(F.broadcast(b)).select("vec_id", V.renormalise(F.col("v"), F.col("mean"), F.col("std"), F.col("mean2"), F.col("std2")).alias("r"))
    return r.select("vec_id", F.round(V.total(F.col("r")), 4).alias("total"))


def _codebook(v: DataFrame) -> DataFrame:
    return v.groupBy(F.col("label").alias("code")).agg(F.min_by("v", "vec_id").alias("vector"))


def _assigned(spark, sf):
    v = _vectors(spark, sf)
    return quantise.nearest(v, _codebook(v), "vec_id", "v")


_ASSIGN = f"""{_V}, book AS (SELECT label AS code, arg_min(v, vec_id) AS b FROM v GROUP BY label),
near AS (SELECT vec_id, code, distance FROM (SELECT vec_id, code, list_sum(list_transform(list_zip(v, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance,
  row_number() OVER (PARTITION BY vec_id ORDER BY list_sum(list_transform(list_zip(v, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), code) AS k FROM v, book) WHERE k = 1)"""


def vq_assign(spark, sf):
    return _assigned(spark, sf).select("vec_id", "code", F.round("distance", 6).alias("distance"))


def vq_decode(spark, sf):
    v = _vectors(spark, sf)
    d = quantise.decoded(_assigned(spark, sf), _codebook(v))
    return d.groupBy("code").agg(F.count("*").alias("n"), F.round(F.avg(F.col("decoded")[0]), 6).alias("first"))


def code_histogram(spark, sf):
    return quantise.usage(_assigned(spark, sf))


def code_perplexity(spark, sf):
    return quantise.perplexity(quantise.usage(_assigned(spark, sf))).select(F.round("perplexity", 6).alias("perplexity"))


def code_ema_step(spark, sf):
    v = _vectors(spark, sf)
    out = quantise.moving_average(_codebook(v), quantise.code_sums(v, _assigned(spark, sf), "vec_id", "v"))
    return out.select("code", "dim", F.round("value", 6).alias("value"), F.round("count", 6).alias("count"))


def _blocked(spark, sf):
    """Whole blocks of BLOCK vectors in md5 order; the first half of each stands for a text, the second for its motion."""
    rows = corpus.placed(_vectors(spark, sf).withColumn("h", F.md5(F.col("vec_id").cast("string"))), ["h", "vec_id"], "place")
    total = rows.agg((F.floor(F.count("*") / BLOCK) * BLOCK).alias("whole"))
    rows = rows.join(F.broadcast(total)).where(F.col("place") < F.col("whole"))
    half = (F.size("v") / 2).cast("int")
    rows = rows.select(F.floor(F.col("place") / BLOCK).alias("block"), (F.col("place") % BLOCK).alias("i"), F.slice("v", F.lit(1), half).alias("a"), F.slice("v", half + 1, half).alias("b"))
    other = rows.select(F.col("block").alias("block2"), F.col("i").alias("j"), F.col("b").alias("b2"))
    return rows.join(other, F.col("block") == F.col("block2")).select("block", "i", "j", F.round(V.distance(F.col("a"), F.col("b2")), 8).alias("distance"))


_BLOCKED = f"""{_V}, placed AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS place FROM v),
whole AS (SELECT place // 32 AS block, place % 32 AS i, v[1:len(v) // 2] AS a, v[len(v) // 2 + 1:] AS b FROM placed WHERE place < (SELECT count(*) // 32 * 32 FROM v)),
pairs AS (SELECT x.block, x.i, y.i AS j, round({_L2.format(a='x.a', b='y.b')}, 8) AS distance FROM whole x JOIN whole y ON x.block = y.block),
ranks AS (SELECT block, i, rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY block, i ORDER BY distance, j) AS rank FROM pairs) WHERE i = j)"""


def pairwise_l2(spark, sf):
    return _blocked(spark, sf).groupBy("block", "i").agg(F.round(F.min("distance"), 6).alias("least"), F.round(F.avg("distance"), 6).alias("mean"))


def r_precision(spark, sf):
    r = metrics.retrieval_ranks(_blocked(spark, sf))
    return r.agg(*[F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"top_{k}") for k in (1, 2, 3)], F.round(F.avg("distance"), 6).alias("matching_score"))


def _drawn(v: DataFrame, by: list[str], n: int) -> DataFrame:
    """n pairs for each of by: two draws without replacement, each in the order of a seeded digest."""
    sides = []
    for seed in ("a", "b"):
        order = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.md5(F.concat(F.lit(seed), F.col("vec_id").cast("string"))), "vec_id")
        k = v.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
        sides.append(k.select(*[F.col(c).alias(f"{c}_{seed}") for c in by], F.col("k").alias(f"k_{seed}"), F.col("v").alias(seed)))
    on = F.col("k_a") == F.col("k_b")
    for c in by:
        on = on & (F.col(f"{c}_a") == F.col(f"{c}_b"))
    return sides[0].join(sides[1], on).withColumn("d", V.distance(F.col("a"), F.col("b")))


def diversity(spark, sf):
    return _drawn(_vectors(spark, sf), [], 300).agg(F.count("*").alias("pairs"), F.round(F.avg("d"), 6).alias("diversity"))


def multimodality(spark, sf):
    return _drawn(_vectors(spark, sf), ["label"], 10).groupBy(F.col("label_a").alias("label")).agg(F.count("*").alias("pairs"), F.round(F.avg("d"), 6).alias("multimodality"))


def _drawn_sql(by: str, n: int) -> str:
    p = f"PARTITION BY {by} " if by else ""
    side = lambda s: f"SELECT *, row_number() OVER ({p}ORDER BY md5('{s}' || CAST(vec_id AS VARCHAR)), vec_id) AS k FROM v"
    same = f" AND a.{by} = b.{by}" if by else ""
    return f"d AS (SELECT a.label, {_L2.format(a='a.v', b='b.v')} AS d FROM ({side('a')}) a JOIN ({side('b')}) b ON a.k = b.k{same} WHERE a.k <= {n})"


def fid_moments(spark, sf):
    v = _vectors(spark, sf).withColumn("g", F.when(F.col("label") < 5, 0).otherwise(1).cast("long"))
    return metrics.covariance(v, "v", "g").select("g", "i", "j", F.round("cov", 8).alias("cov"), F.round("mean_i", 8).alias("mean_i"))


def fid(spark, sf):
    v = _vectors(spark, sf).withColumn("g", F.when(F.col("label") < 5, 0).otherwise(1).cast("long"))
    rows = metrics.covariance(v, "v", "g").collect()  # two matrices of the vectors' dimension
    dim = max((r.j for r in rows), default=-1) + 1
    return spark.createDataFrame([(round(metrics.frechet(rows, dim, 0, 1), 6),)], "fid double")


def kid(spark, sf):
    v = _vectors(spark, sf).withColumn("g", F.when(F.col("label") < 5, 0).when(F.col("label") >= 5, 1))
    return metrics.kernel_distance(v, "v", "g", "vec_id").agg(F.avg("d").alias("kid"), F.stddev_pop("d").alias("deviation"))


def quaternion_kit(spark, sf):
    v = _vectors(spark, sf)
    q, r, p = (F.slice("v", a, n) for a, n in ((1, 4), (5, 4), (9, 3)))
    rows = v.select("vec_id", G.q_normal(q).alias("q"), G.q_normal(r).alias("r"), p.alias("p"))
    rows = rows.select("vec_id", G.q_mul(F.col("q"), F.col("r")).alias("m"), G.q_rotate(F.col("q"), F.col("p")).alias("t"))
    return rows.select("vec_id", *[F.round(F.col("m")[i], 6).alias(f"m{i}") for i in range(4)], *[F.round(F.col("t")[i], 6).alias(f"t{i}") for i in range(3)])


_QUAT = f"""WITH {_V}, n AS (SELECT vec_id, v[1] / a AS w, v[2] / a AS x, v[3] / a AS y, v[4] / a AS z, v[5] / b AS e, v[6] / b AS f, v[7] / b AS g, v[8] / b AS h, v[9] AS px, v[10] AS py, v[11] AS pz
  FROM (SELECT *, sqrt(v[1]*v[1] + v[2]*v[2] + v[3]*v[3] + v[4]*v[4]) AS a, sqrt(v[5]*v[5] + v[6]*v[6] + v[7]*v[7] + v[8]*v[8]) AS b FROM v))
SELECT vec_id, round(w*e - x*f - y*g - z*h, 6) AS m0, round(w*f + x*e + y*h - z*g, 6) AS m1, round(w*g - x*h + y*e + z*f, 6) AS m2, round(w*h + x*g - y*f + z*e, 6) AS m3,
 round((1 - 2*(y*y + z*z))*px + 2*(x*y - z*w)*py + 2*(x*z + y*w)*pz, 6) AS t0, round(2*(x*y + z*w)*px + (1 - 2*(x*x + z*z))*py + 2*(y*z - x*w)*pz, 6) AS t1, round(2*(x*z - y*w)*px + 2*(y*z + x*w)*py + (1 - 2*(x*x + y*y))*pz, 6) AS t2 FROM n"""


def rotation_round_trip(spark, sf):
    """Largest error of each representation of a rotation after a way there and back."""
    rows = _vectors(spark, sf).select(G.six_to_matrix(F.slice("v", 1, 6)).alias("m"))
    error = lambda k: F.round(F.max(F.array_max(F.zip_with("m", G.to_matrix(k, G.matrix_to(k, F.col("m"))), lambda a, b: F.abs(a - b)))), 6).alias(k)
    return rows.agg(*[error(k) for k in G.WIDTHS])


def _poses(spark, sf):
    """Pose of 21 joints from each vector, with that of the vector after it."""
    v = _vectors(spark, sf).select("vec_id", "label", F.slice("v", 1, 63).alias("p"))
    after = v.select((F.col("vec_id") - 1).alias("a_id"), F.col("p").alias("r"))
    return v.join(after, F.col("vec_id") == F.col("a_id")).select("vec_id", "label", "p", "r")


def mpjpe(spark, sf):
    joint = lambda c, j, k: F.element_at(c, 3 * j + k + 1) - F.element_at(c, k + 1)
    rows = _poses(spark, sf)
    p, r = F.col("p"), F.col("r")
    d = sum((F.sqrt(sum(((joint(p, j, k) - joint(r, j, k)) ** 2 for k in (1, 2)), (joint(p, j, 0) - joint(r, j, 0)) ** 2)) for j in range(1, 21)), F.lit(0.0)) / 21
    return rows.groupBy("label").agg(F.count("*").alias("frames"), F.round(F.sum(d) / F.count("*") * 1000, 4).alias("mpjpe"))


@F.pandas_udf(DoubleType())
def _aligned_error(p: pd.Series, r: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(p, r):
        a, b = np.reshape(a, (-1, 3)), np.reshape(b, (-1, 3))
        out.append(float(np.linalg.norm(metrics.procrustes(a, b) - b, axis=1).mean()))
    return pd.Series(out)


def pa_mpjpe(spark, sf):
    return _poses(spark, sf).groupBy("label").agg(F.count("*").alias("frames"), F.round(F.avg(_aligned_error("p", "r")) * 1000, 4).alias("pa_mpjpe"))


#: The chains of the 21-joint skeleton.
CHAINS = ((0, 11, 12, 13, 14, 15), (0, 16, 17, 18, 19, 20), (0, 1, 2, 3, 4), (3, 5, 6, 7), (3, 8, 9, 10))


def bone_lengths(spark, sf):
    """Mean length of each bone: joints of a frame joined with their parents."""
    joints = _vectors(spark, sf).select("vec_id", F.posexplode(V.pieces(F.slice("v", 1, 63), 3)).alias("joint", "xyz"))
    bones = spark.createDataFrame([(a, b) for c in CHAINS for a, b in zip(c, c[1:])], "parent int, child int")
    up = joints.select(F.col("vec_id").alias("u"), F.col("joint").alias("up"), F.col("xyz").alias("at"))
    own = joints.join(F.broadcast(bones), F.col("joint") == F.col("child")).join(up, (F.col("vec_id") == F.col("u")) & (F.col("parent") == F.col("up")))
    return own.groupBy("parent", "child").agg(F.round(F.avg(V.distance(F.col("xyz"), F.col("at"))), 6).alias("length"))


def smooth_l1(spark, sf):
    rows = _poses(spark, sf)
    d = V.total(F.zip_with("p", "r", lambda a, b: V.smooth_l1(a * 10, b * 10))) / 63
    return rows.groupBy("label").agg(F.round(F.avg(d), 6).alias("loss"))


def pad_mask(spark, sf):
    """A ragged cut of each vector filled to 64 places, with its mask."""
    n = (F.col("vec_id") % 70).cast("int")
    rows = _vectors(spark, sf).select("vec_id", n.alias("n"), V.pad(F.slice("v", F.lit(1), n), 64).alias("x"), V.mask(n, 64).alias("m"))
    return rows.select("vec_id", F.size("x").alias("size"), F.round(V.total(F.col("x")), 6).alias("total"), F.size(F.filter("m", lambda b: b)).alias("valid"), V.whole_units(F.col("n")).alias("whole"))


QUERIES = {f.__name__: f for f in (dense_topk, feature_stats, zscore, renorm, vq_assign, vq_decode, code_histogram, code_perplexity, code_ema_step, pairwise_l2, r_precision, diversity, multimodality, fid_moments, fid, kid, quaternion_kit, rotation_round_trip, mpjpe, pa_mpjpe, bone_lengths, smooth_l1, pad_mask)}

_STAT = "SELECT dim, avg(x) AS m, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 1e-6)) AS s FROM dims"
_POSES = f"{_V}, poses AS (SELECT a.vec_id, a.label, a.v[1:63] AS p, b.v[1:63] AS r FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)"
ORACLES = {
    "dense_topk": f"WITH {_V}, s AS (SELECT q.vec_id AS q, c.vec_id AS id, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0) SELECT q, CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5",
    "feature_stats": f"WITH {_V}, {_DIMS} SELECT CAST(dim AS INTEGER) AS dim, count(*) AS n, round(avg(x), 8) AS mean, round(sqrt(greatest(avg(x * x) - avg(x) * avg(x), 1e-6)), 8) AS std FROM dims GROUP BY dim",
    "zscore": f"WITH {_V}, {_DIMS}, s AS ({_STAT} GROUP BY dim), z AS (SELECT vec_id, dim, (x - m) / s AS z FROM dims JOIN s USING (dim)) SELECT vec_id, round(max(CASE WHEN dim = 0 THEN z END), 6) AS first, round(sum(z * z), 4) AS energy FROM z GROUP BY vec_id",
    "renorm": f"WITH {_V}, {_DIMS}, a AS ({_STAT} WHERE label < 5 GROUP BY dim), b AS ({_STAT} WHERE label >= 5 GROUP BY dim) SELECT vec_id, round(sum((x * a.s + a.m - b.m) / b.s), 4) AS total FROM dims JOIN a USING (dim) JOIN b USING (dim) GROUP BY vec_id",
    "vq_assign": f"WITH {_ASSIGN} SELECT vec_id, code, round(distance, 6) AS distance FROM near",
    "vq_decode": f"WITH {_ASSIGN} SELECT code, count(*) AS n, round(avg(b[1]), 6) AS first FROM near JOIN book USING (code) GROUP BY code",
    "code_histogram": f"WITH {_ASSIGN} SELECT code, count(*) AS n FROM near GROUP BY code",
    "code_perplexity": f"WITH {_ASSIGN}, c AS (SELECT count(*) / (SELECT count(*) FROM near) AS p FROM near GROUP BY code) SELECT round(exp(-sum(p * ln(p + 1e-7))), 6) AS perplexity FROM c",
    "code_ema_step": f"""WITH {_ASSIGN}, {_DIMS}, s AS (SELECT code, dim, sum(x) AS total, count(*) AS n FROM near JOIN dims USING (vec_id) GROUP BY code, dim),
o AS (SELECT code, unnest(b) AS old, generate_subscripts(b, 1) - 1 AS dim FROM book), m AS (SELECT code, dim, old, 0.99::DOUBLE * old + 0.01::DOUBLE * coalesce(total, 0) AS t, 0.99::DOUBLE + 0.01::DOUBLE * coalesce(n, 0) AS c FROM o LEFT JOIN s USING (code, dim))
SELECT code, CAST(dim AS INTEGER) AS dim, round(CASE WHEN c >= 1 THEN t / c ELSE old END, 6) AS value, round(c, 6) AS count FROM m""",
    "pairwise_l2": f"WITH {_BLOCKED} SELECT block, i, round(min(distance), 6) AS least, round(avg(distance), 6) AS mean FROM pairs GROUP BY block, i",
    "r_precision": f"WITH {_BLOCKED} SELECT round(avg(CAST(rank <= 1 AS INTEGER)), 6) AS top_1, round(avg(CAST(rank <= 2 AS INTEGER)), 6) AS top_2, round(avg(CAST(rank <= 3 AS INTEGER)), 6) AS top_3, round(avg(distance), 6) AS matching_score FROM ranks",
    "diversity": f"WITH {_V}, {_drawn_sql('', 300)} SELECT count(*) AS pairs, round(avg(d), 6) AS diversity FROM d",
    "multimodality": f"WITH {_V}, {_drawn_sql('label', 10)} SELECT label, count(*) AS pairs, round(avg(d), 6) AS multimodality FROM d GROUP BY label",
    "fid_moments": f"""WITH {_V}, {_DIMS}, g AS (SELECT vec_id, CAST(dim AS INTEGER) AS dim, x, CASE WHEN label < 5 THEN 0 ELSE 1 END AS g FROM dims)
SELECT CAST(a.g AS BIGINT) AS g, a.dim AS i, b.dim AS j, round(covar_samp(a.x, b.x), 8) AS cov, round(avg(a.x), 8) AS mean_i FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY 1, 2, 3""",
    "quaternion_kit": _QUAT,
    "rotation_round_trip": "SELECT " + ", ".join(f"0.0::DOUBLE AS {k}" for k in G.WIDTHS),
    "mpjpe": f"WITH {_POSES} SELECT label, count(*) AS frames, round(sum(list_sum(list_transform(range(1, 21), lambda j: sqrt(list_sum(list_transform([1, 2, 3], lambda k: ((p[3*j+k] - p[k]) - (r[3*j+k] - r[k])) ** 2))))) / 21) / count(*) * 1000, 4) AS mpjpe FROM poses GROUP BY label",
    "bone_lengths": f"WITH {_V}, bones(parent, child) AS (VALUES {', '.join(f'({a}, {b})' for c in CHAINS for a, b in zip(c, c[1:]))}) SELECT parent, child, round(avg(sqrt((v[3*parent+1] - v[3*child+1]) ** 2 + (v[3*parent+2] - v[3*child+2]) ** 2 + (v[3*parent+3] - v[3*child+3]) ** 2)), 6) AS length FROM v, bones GROUP BY 1, 2",
    "smooth_l1": f"WITH {_POSES} SELECT label, round(avg(list_sum(list_transform(list_zip(p, r), lambda z: CASE WHEN abs(z[1] - z[2]) * 10 < 1 THEN (z[1] - z[2]) ** 2 * 50 ELSE abs(z[1] - z[2]) * 10 - 0.5 END)) / 63), 6) AS loss FROM poses GROUP BY label",
    "pad_mask": f"WITH {_V} SELECT vec_id, 64 AS size, round(coalesce(list_sum(v[1:vec_id % 70]), 0), 6) AS total, CAST(least(64, vec_id % 70) AS INTEGER) AS valid, vec_id % 70 // 4 * 4 AS whole FROM v",
}
