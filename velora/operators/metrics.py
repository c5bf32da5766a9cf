"""Evaluation metrics as aggregates."""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from velora.functions.arrow import matrix
from velora.functions.sampling import below
from velora.functions.text import tokens
from velora.functions.vector import distance, let
from velora.operators.corpus import placed, placed_within
from velora.sources.staging import small_batches, staged


def _coded(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    codes: dict = {}
    return tuple(np.array([codes.setdefault(x, len(codes)) for x in side], np.int64) for side in (a, b))


def _edits(a: list, b: list) -> int:
    """A row of the table at a time: what comes from the row above is taken at once, what comes from the left is a running minimum."""
    x, y = _coded(a, b)
    step = np.arange(len(y) + 1)
    row = step.copy()
    for c in x:
        new = row + 1
        np.minimum(new[1:], row[:-1] + (y != c), out=new[1:])
        row = np.minimum.accumulate(new - step) + step
    return int(row[-1])


@F.pandas_udf(IntegerType())
def token_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance over tokens."""
    return pd.Series([_edits(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")


def _common(a: list, b: list) -> int:
    """A row of the table at a time; rows never fall, so what comes from the left is a running maximum."""
    x, y = _coded(a, b)
    row = np.zeros(len(y) + 1, np.int64)
    for c in x:
        new = row.copy()
        np.maximum(new[1:], row[:-1] + (y == c), out=new[1:])
        row = np.maximum.accumulate(new)
    return int(row[-1])


@F.pandas_udf(IntegerType())
def longest_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of tokens."""
    return pd.Series([_common(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")


def overlap(a: Column, b: Column) -> Column:
    """Size of the bag intersection of two token arrays: both sorted together, each run of a token gives the lesser of its two counts."""
    both = F.array_sort(F.concat(F.transform(a, lambda x: F.struct(x.alias("t"), F.lit(1).alias("a"), F.lit(0).alias("b"))), F.transform(b, lambda x: F.struct(x.alias("t"), F.lit(0).alias("a"), F.lit(1).alias("b")))))
    begin = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("done"))

    def step(run: Column, z: Column) -> Column:
        same = run["t"].eqNullSafe(z["t"])
        held = lambda side: F.when(same, run[side]).otherwise(0) + z[side]
        done = run["done"] + F.when(same, 0).otherwise(F.least(run["a"], run["b"]))
        return F.struct(z["t"].alias("t"), held("a").alias("a"), held("b").alias("b"), done.alias("done"))

    return F.aggregate(both, begin, step, lambda run: run["done"] + F.least(run["a"], run["b"]))


def token_f1(a: Column, b: Column) -> Column:
    o = overlap(a, b).cast("double")
    return F.when(o == 0, 0.0).otherwise(2 * (o / F.size(a)) * (o / F.size(b)) / (o / F.size(a) + o / F.size(b)))


def sequence_scores(pairs: DataFrame, pred: str, ref: str) -> DataFrame:
    """One row: wer (ratio of sums), exact_match, token_f1, rouge_l, mean lengths; rounded to 4 places."""
    rows = pairs.select(tokens(F.col(pred)).alias("p"), tokens(F.col(ref)).alias("r"))
    rows = rows.withColumn("edits", token_edits("p", "r")).withColumn("lcs", longest_common("p", "r"))
    rouge = F.when(F.col("lcs") == 0, 0.0).otherwise(2.0 * F.col("lcs") / (F.size("p") + F.size("r")))
    return rows.agg(
        F.bround(F.sum("edits") / F.greatest(F.sum(F.size("r")), F.lit(1)), 4).alias("wer"),
        F.bround(F.avg((F.col("p") == F.col("r")).cast("int")), 4).alias("exact_match"),
        F.bround(F.avg(token_f1(F.col("p"), F.col("r"))), 4).alias("token_f1"),
        F.bround(F.avg(rouge), 4).alias("rouge_l"),
        F.bround(F.avg(F.size("p")), 4).alias("pred_len"),
        F.bround(F.avg(F.size("r")), 4).alias("ref_len"),
    )


def _common_grams(orders: int):
    """(n, matched, a, b, apart) of a task's rows (p, r): n-grams of both sides by order, each row for itself. apart: grams of one side only."""

    def run(batches):
        sums = np.zeros((orders, 4), np.int64)
        for batch in batches:
            for p, r in zip(*(c.to_pylist() for c in batch.columns)):
                p, r = (x if isinstance(x, str) else tuple(x) for x in (p, r))
                for n in range(1, orders + 1):
                    a, b = (Counter([x[i : i + n] for i in range(len(x) - n + 1)]) for x in (p, r))
                    both = a.keys() & b.keys()
                    known_a, known_b = sum(map(a.__getitem__, both)), sum(map(b.__getitem__, both))
                    a_all, b_all = max(len(p) - n + 1, 0), max(len(r) - n + 1, 0)
                    sums[n - 1] += sum(map(min, map(a.__getitem__, both), map(b.__getitem__, both))), a_all, b_all, a_all - known_a + b_all - known_b
        yield pa.record_batch([pa.array(range(1, orders + 1), pa.int32()), *(pa.array(sums[:, k]) for k in range(4))], names=["n", "matched", "a", "b", "apart"])

    return run


def gram_matches(sides: DataFrame, orders: int, glue: str) -> DataFrame:
    """(n, matched, a, b, apart) for n-grams of 1 to orders items of rows (id, p, r): of all ids, how many p and r share (each counted up to the other side's), how many either has, and
    how many are on one side only.

    p and r are both arrays of items, or both texts whose letters are the items. Rows are written once. A row whose id is its own is counted where it is; rows that share an id
    are counted as one, over their n-grams.
    """
    rows = staged(sides.select("id", "p", "r").where("p is not null and r is not null"), "gram-sides")
    shared = staged(rows.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("id").alias("_id")), "gram-ids")
    own = rows.join(shared, F.col("id").eqNullSafe(F.col("_id")), "left_anti").select("p", "r").mapInArrow(_common_grams(orders), "n int, matched long, a long, b long, apart long")
    items = lambda side: F.regexp_extract_all(side, F.lit("(?s)."), F.lit(0)) if dict(rows.dtypes)[side] == "string" else F.col(side)
    named = lambda n: lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"))
    grams = lambda side: F.flatten(F.array(*[F.transform(_runs(items(side), n, glue), named(n)) for n in range(1, orders + 1)]))
    again = rows.join(shared, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    one = lambda side, a, b: again.select("id", F.explode(grams(side)).alias("z"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    many = one("p", 1, 0).union(one("r", 0, 1)).groupBy("id", "z.n", "z.g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    apart = F.when(F.least("a", "b") == 0, F.greatest("a", "b")).otherwise(0)
    many = many.select("n", F.least("a", "b").alias("matched"), "a", "b", apart.alias("apart"))
    return own.union(many).groupBy("n").agg(*[F.sum(c).alias(c) for c in ("matched", "a", "b", "apart")])


def clipped_ngrams(pairs: DataFrame, id_col: str, pred: str, ref: str, orders: int) -> DataFrame:
    """(matched, total, n) of corpus BLEU for n-grams of 1 to orders words: counts of the prediction clipped by the reference's. Both are null for an order without n-grams."""
    found = gram_matches(pairs.select(F.col(id_col).alias("id"), tokens(F.col(pred)).alias("p"), tokens(F.col(ref)).alias("r")), orders, " ").where("a > 0")
    at = lambda name, n: F.max(F.when(F.col("n") == n, F.col(name)))
    row = found.agg(F.array(*[F.struct(at("matched", n).alias("matched"), at("a", n).alias("total"), F.lit(n).alias("n")) for n in range(1, orders + 1)]).alias("all"))
    return row.select(F.explode("all").alias("z")).select("z.matched", "z.total", "z.n")


def moments(df: DataFrame, vector: str, least: float = 1e-6) -> DataFrame:
    """(dim, n, mean, std) in one pass: population deviation with a floor of the variance."""
    x = F.col("x").cast("double")
    rows = df.select(F.posexplode(vector).alias("dim", "x"))
    sums = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
    mean = F.col("s") / F.col("n")
    return sums.select("dim", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(least))).alias("std"))


def _partial_products(vector_at: int, group_at: int | None):
    def run(batches):
        sums: dict = {}
        for b in batches:
            x = matrix(b.column(vector_at))
            groups = np.zeros(len(b), int) if group_at is None else b.column(group_at).to_numpy()
            for g in np.unique(groups):
                own = x[groups == g]
                n, s, p = sums.get(g, (0, 0.0, 0.0))
                sums[g] = n + len(own), s + own.sum(0), p + own.T @ own
        rows = [(int(g), n, s.tolist(), p.ravel().tolist()) for g, (n, s, p) in sums.items()]
        g, n, s, p = zip(*rows) if rows else ((), (), (), ())
        yield pa.record_batch([pa.array(g, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.float64())), pa.array(p, pa.list_(pa.float64()))], names=["g", "n", "s", "p"])

    return run


def covariance(df: DataFrame, vector: str, group: str | None = None) -> DataFrame:
    """(g, i, j, cov) for i <= j, and the means as j = -1: sample covariance from one partial matrix a task."""
    cols = [vector] if group is None else [vector, group]
    part = df.where(F.col(vector).isNotNull()).select(*cols).mapInArrow(_partial_products(0, None if group is None else 1), "g long, n long, s array<double>, p array<double>")
    n = part.groupBy("g").agg(F.sum("n").alias("n"))
    s = part.select("g", F.posexplode("s").alias("i", "v")).groupBy("g", "i").agg(F.sum("v").alias("s"))
    d = F.sqrt(F.size("p")).cast("int")
    p = part.select("g", d.alias("d"), F.posexplode("p").alias("k", "v")).withColumn("i", F.floor(F.col("k") / F.col("d")).cast("int")).withColumn("j", F.col("k") % F.col("d")).where("i <= j").groupBy("g", "i", "j").agg(F.sum("v").alias("p"))
    left, right = s.select("g", F.col("i"), F.col("s").alias("si")), s.select(F.col("g").alias("g2"), F.col("i").alias("j2"), F.col("s").alias("sj"))
    both = p.join(n, "g").join(left, ["g", "i"]).join(right, (F.col("g") == F.col("g2")) & (F.col("j") == F.col("j2")))
    return both.select("g", "i", "j", ((F.col("p") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).alias("cov"), (F.col("si") / F.col("n")).alias("mean_i"))


def frechet(rows: list, dim: int, a: int, b: int, jitter: float = 1e-6) -> float:
    """Distance of two Gaussians from covariance rows (g, i, j, cov, mean_i)."""
    mean, cov = {g: np.zeros(dim) for g in (a, b)}, {g: np.zeros((dim, dim)) for g in (a, b)}
    for g, i, j, c, m in rows:
        if g in cov:
            cov[g][i, j] = cov[g][j, i] = c
            mean[g][i] = m
    roots = np.sqrt(np.linalg.eigvals(cov[a] @ cov[b]).astype(complex))
    if not np.isfinite(roots).all():
        eye = jitter * np.eye(dim)
        roots = np.sqrt(np.linalg.eigvals((cov[a] + eye) @ (cov[b] + eye)).astype(complex))
    d = mean[a] - mean[b]
    return float(d @ d + np.trace(cov[a]) + np.trace(cov[b]) - 2 * roots.sum().real)


def discrepancy(x: np.ndarray, y: np.ndarray) -> float:
    """Unbiased squared discrepancy of two sets of equally many vectors under (x y / d + 1)^3."""
    n = len(x)
    k = lambda a, b: (a @ b.T / a.shape[1] + 1) ** 3
    aa, bb = k(x, x), k(y, y)
    return float((aa.sum() - np.trace(aa) + bb.sum() - np.trace(bb)) / (n * (n - 1)) - 2 * k(x, y).mean())


def kernel_distance(df: DataFrame, vector: str, group: str, id_col: str, subsets: int = 100, size: int = 1000) -> DataFrame:
    """(seed, d): the discrepancy of groups 0 and 1 over seeded subsets without replacement.

    Subset s of a group holds the `size` rows with the smallest md5 of "s:id", of all its rows; equal ids go by vector. If a group
    has fewer rows than size, subsets are of that many; under two rows there is no result. A row goes to a subset's task only if its
    digest is below a bound that leaves somewhat more than size rows.
    """
    rows = df.where(F.col(group).isin(0, 1) & F.col(vector).isNotNull())
    n = {r.g: r.n for r in rows.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n")).collect()}
    size = min(size, n.get(0, 0), n.get(1, 0))
    seeds = F.explode(F.sequence(F.lit(0), F.lit(subsets - 1)))
    digest = F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.coalesce(F.col("i"), F.lit(""))))
    rows = rows.select(F.col(group).cast("long").alias("g"), F.col(id_col).cast("string").alias("i"), F.col(vector).alias("v"), seeds.alias("seed")).withColumn("digest", digest)
    at = F.conv(F.substring("digest", 1, 12), 16, 10).cast("long") / float(16**12)

    def subset(table: pa.Table) -> pa.Table:
        g, digests, v = (table.column(c).to_pylist() for c in ("g", "digest", "v"))
        halves = [[x for _, x in sorted((d, x) for h, d, x in zip(g, digests, v) if h == k)[:size]] for k in (0, 1)]
        whole = min(map(len, halves)) == size
        return pa.table({"seed": table.column("seed")[:1], "d": pa.array([discrepancy(*map(np.array, halves)) if whole else None], pa.float64())})

    slack = 20.0
    while size > 1:
        bound = F.lit(0.0)
        for k in (0, 1):
            bound = F.when(F.col("g") == k, min(2.0, (size + slack * size**0.5) / n[k])).otherwise(bound)
        out = rows.where(at < bound).groupBy("seed").applyInArrow(subset, "seed int, d double").collect()  # two numbers a subset
        if len(out) == subsets and all(r.d is not None for r in out):
            return df.sparkSession.createDataFrame(sorted(out), "seed int, d double")
        slack *= 8  # many rows of one id fall in or out together
    return df.sparkSession.createDataFrame([], "seed int, d double")


def interval(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean over replications and the half width of its 95 % interval, with the population deviation."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (1.96 * F.stddev_pop(value) / F.sqrt(F.count(value))).alias("ci"))


def retrieval_ranks(pairs: DataFrame, block: str = "block") -> DataFrame:
    """(block, i, rank, distance) of the true match from all-pairs distances (block, i, j, distance) inside blocks."""
    order = Window.partitionBy(block, "i").orderBy("distance", "j")
    return pairs.withColumn("rank", F.row_number().over(order)).where("i = j").select(block, "i", "rank", "distance")


def procrustes(pred: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """pred turned, scaled and moved to fit ref best."""
    a, b = pred - pred.mean(0), ref - ref.mean(0)
    u, s, vt = np.linalg.svd(a.T @ b)
    z = np.ones(len(s))
    z[-1] = np.sign(np.linalg.det(vt.T @ u.T)) or 1
    turn = vt.T @ np.diag(z) @ u.T
    scale = (s * z).sum() / max((a * a).sum(), 1e-300)
    return scale * a @ turn.T + ref.mean(0)


def bleu(pairs: DataFrame, id_col: str, pred: str, ref: str, orders: int = 4) -> DataFrame:
    """One row with the corpus BLEU of white-space tokens, in percent: the geometric mean of the n-gram precisions times the brevity penalty. The k-th order
    without a match counts as 100 / (2**k total); no match at all, or no n-gram of some order, makes 0."""
    n = range(1, orders + 1)
    counts = clipped_ngrams(pairs, id_col, pred, ref, orders)
    lengths = pairs.agg(F.sum(F.size(tokens(F.col(pred)))).alias("pred_len"), F.sum(F.size(tokens(F.col(ref)))).alias("ref_len"))
    at = lambda name, k: F.coalesce(F.max(F.when(F.col("n") == k, F.col(name))), F.lit(0)).alias(f"{name}{k}")
    row = counts.agg(*[at(name, k) for name in ("matched", "total") for k in n]).join(F.broadcast(lengths))  # one row each
    logs, misses = F.lit(0.0), F.lit(0)
    for k in n:
        misses = misses + (F.col(f"matched{k}") == 0).cast("int")
        hit = F.when(F.col(f"matched{k}") == 0, 1 / F.pow(F.lit(2.0), misses)).otherwise(F.col(f"matched{k}").cast("double"))
        logs = logs + F.log(hit / F.col(f"total{k}"))
    brief = F.when(F.col("pred_len") < F.col("ref_len"), F.exp(1 - F.col("ref_len") / F.col("pred_len"))).otherwise(1.0)
    none = (F.greatest(*[F.col(f"matched{k}") for k in n]) == 0) | (F.least(*[F.col(f"total{k}") for k in n]) == 0)
    return row.select("pred_len", "ref_len", F.when(none, 0.0).otherwise(100 * brief * F.exp(logs / orders)).alias("bleu"))


def chrf(pairs: DataFrame, id_col: str, pred: str, ref: str, orders: int = 6, beta: float = 2.0) -> DataFrame:
    """One row with the corpus chrF in percent: the F score of the mean precision and the mean recall of character n-grams without white space. Orders that one side lacks don't count."""
    letters = lambda c: F.array_join(tokens(F.col(c)), "")
    found = gram_matches(pairs.select(F.col(id_col).alias("id"), letters(pred).alias("p"), letters(ref).alias("r")), orders, "")
    both = found.where("a > 0 AND b > 0").select((F.col("matched") + F.col("apart")).alias("m"), "a", "b")  # as in the SQL, what one side lacks counts as the other has it
    means = both.agg(F.coalesce(F.avg(F.coalesce("m", F.lit(0)) / F.col("a")), F.lit(0.0)).alias("precision"), F.coalesce(F.avg(F.coalesce("m", F.lit(0)) / F.col("b")), F.lit(0.0)).alias("recall"))
    p, r, w = F.col("precision"), F.col("recall"), beta * beta
    return means.select("precision", "recall", F.when(p + r > 0, 100 * (1 + w) * p * r / (w * p + r)).otherwise(0.0).alias("chrf"))


def _runs(items: Column | str, n: int, glue: str) -> Column:
    """All runs of n neighbouring items, joined."""
    items = F.col(items) if isinstance(items, str) else items
    make = lambda own: F.transform(F.sequence(F.lit(1), F.size(own) - n + 1), lambda i: F.array_join(F.slice(own, i, F.lit(n)), glue))
    return let(items, lambda own: F.when(F.size(own) >= n, make(own)).otherwise(F.array().cast("array<string>")))


def variance(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Squared deviations from the mean over one less than their number."""
    return df.groupBy(*by).agg(F.var_samp(value).alias("variance"))


def valid_mean(error: Column, x: Column, missing: float = -2.0) -> Column:
    """Mean over the joints whose first coordinate isn't the mark of a missing one."""
    return F.avg(F.when(x != missing, error))


def conditional_spread(rows: DataFrame, label: str, vector: str, order: str, labels: int, times: int, whole: int = 200) -> DataFrame:
    """One row: diversity, the mean distance of `whole` seeded pairs with replacement of all rows; and multimodality, that of `times` such pairs within each label that occurs, over
    times * labels, whether they occur or not. Rows are found by their places, which are counted over sorted ranges: no label is one task's."""
    ranked = rows.select(F.col(label).alias("label"), F.col(order).alias("o"), F.col(vector).alias("v"))
    inner = placed_within(ranked, "label", ["o"]).select("label", "place", "v")
    n = inner.groupBy("label").agg(F.count("*").alias("n"))
    drawn = _pairs_at(n, inner, times, "label").agg((F.sum(distance(F.col("first_v"), F.col("second_v"))) / (times * labels)).alias("multimodality"))
    every = placed(ranked, ["o"]).select(F.lit(0).alias("all"), "place", "v")
    total = every.groupBy("all").agg(F.count("*").alias("n"))
    wide = _pairs_at(total, every, whole, "all").agg((F.sum(distance(F.col("first_v"), F.col("second_v"))) / whole).alias("diversity"))
    return wide.join(F.broadcast(drawn))  # one row each


def _pairs_at(n: DataFrame, rows: DataFrame, times: int, by: str) -> DataFrame:
    """(first_v, second_v): vectors at two seeded places below n for each of `times` draws of each group."""
    draws = n.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    for side in ("first", "second"):
        draws = draws.withColumn(side, below(F.col("n"), side, F.col(by), F.col("t")))
        at = rows.select(F.col(by).alias(f"{side}_by"), F.col("place").alias(f"{side}_place"), F.col("v").alias(f"{side}_v"))
        draws = draws.join(at, (F.col(by) == F.col(f"{side}_by")) & (F.col(side) == F.col(f"{side}_place")))
    return draws


#: Fixed value: how far lengths may differ, in words, before a caption's score falls.
LENGTH_SPREAD = 6.0
#: Bytes of the texts whose n-grams a task adds up at once: n-grams take some fifty times as much.
TASK_BYTES = 1 << 20
#: Odd factors of a gram's words, two for each place, and what marks its order.
_FACTORS = np.array([int.from_bytes(hashlib.blake2b(b"velora-%d" % k, digest_size=8).digest(), "little") | 1 for k in range(64)], np.uint64).reshape(2, 32)


def _gram_hashes(words: pa.ListArray, orders: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each n-gram's row, order from 0, and hash in two halves. A word's digest is made once; a gram's is the sum of its words' by factors of their places."""
    flat = words.flatten().dictionary_encode()
    digests = b"".join(hashlib.blake2b(w.encode(), digest_size=16).digest() for w in flat.dictionary.to_pylist())
    word = np.frombuffer(digests, np.uint64).reshape(-1, 2)[flat.indices.to_numpy()].T
    n = pa.compute.fill_null(pa.compute.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    row, left = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n), n) - np.arange(n.sum())  # words from here to the row's end
    rows, order, halves = [], [], []
    sums = np.zeros_like(word)
    for k in range(orders):
        sums = sums[:, : word.shape[1] - k] + word[:, k:] * _FACTORS[:, k % 31, None] if word.shape[1] > k else sums[:, :0]
        at = np.flatnonzero(left[: sums.shape[1]] > k)
        rows, order, halves = [*rows, row[at]], [*order, np.full(len(at), k)], [*halves, sums[:, at] + _FACTORS[:, 31, None] * np.uint64(k + 1)]
    high, low = np.concatenate(halves, axis=1).view(np.int64)
    return np.concatenate(rows), np.concatenate(order), high, low


def _codes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal values have equal numbers from 0; null is -1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.compute.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _set_counts(orders: int):
    """(part, high, low, n): in how many ids' references of a task's part an n-gram is; 0 for one that only predictions have."""

    def run(batches):
        table = list(batches)
        if not table:
            return
        table = pa.Table.from_batches(table)
        parts = table.column("part").to_numpy()
        for part in np.unique(parts):
            own = table.filter(pa.array(parts == part)).combine_chunks()
            row, _, high, low = _gram_hashes(own.column("w").combine_chunks(), orders)
            holder = np.where(own.column("pred").to_numpy(zero_copy_only=False), -1, _codes(own.column("id")))[row]
            by = np.lexsort((holder, low, high))
            holder, high, low = holder[by], high[by], low[by]
            new = np.append(True, (np.diff(high) != 0) | (np.diff(low) != 0))[: len(high)]
            once = (new | np.append(True, np.diff(holder) != 0)[: len(high)]) & (holder >= 0)
            at = np.flatnonzero(new)
            n = np.add.reduceat(once.astype(np.int64), at) if len(at) else np.empty(0, np.int64)
            yield pa.record_batch([pa.array(np.full(len(at), part, np.int32)), pa.array(high[at]), pa.array(low[at]), pa.array(n)], names=["part", "high", "low", "n"])

    return run


def _cider_scores(orders: int, sets: int):
    """(id, cider) of a part's texts (id, ref, pred, w), with the n-grams (high, df) of it that several ids' references have; the others count as one id's."""

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        words, pred, id_ = texts.column("w").combine_chunks(), texts.column("pred").to_numpy(zero_copy_only=False), _codes(texts.column("id"))
        ref = np.where(pred, -2, _codes(texts.column("ref")))
        (key, group), n_ids = np.unique(np.stack([id_, ref]), axis=1, return_inverse=True), int(id_.max()) + 1
        group = group.reshape(-1)  # texts of one id and reference count as one
        asks = np.full(n_ids, -1)
        asks[key[0, key[1] == -2]] = np.flatnonzero(key[1] == -2)

        row, order, h, _ = _gram_hashes(words, orders)
        by_df = np.argsort(known.column("high").to_numpy(), kind="stable")
        names, dfs = known.column("high").to_numpy()[by_df], known.column("df").to_numpy()[by_df]
        slot = group[row] * orders + order
        by = np.lexsort((h, slot))
        slot, h = slot[by], h[by]
        first = np.flatnonzero(np.append(True, (np.diff(slot) != 0) | (np.diff(h) != 0))[: len(h)])
        tf, slot, h = np.diff(np.append(first, len(h))), slot[first], h[first]
        df = np.ones(len(h))
        if len(names):
            at = np.minimum(np.searchsorted(names, h), len(names) - 1)
            df = np.where(names[at] == h, dfs[at], 1)
        weight = tf * (np.log(max(sets, 1)) - np.log(df))
        length = np.sqrt(np.bincount(slot, weight * weight, len(key[0]) * orders))

        mine = asks[key[0]][slot // orders] * orders + slot % orders  # the slot of the same id's prediction
        _, code = np.unique(h, return_inverse=True)
        place = slot * (len(h) + 1) + code
        asked = np.flatnonzero(key[1][slot // orders] == -2)
        by = asked[np.argsort(place[asked])]
        there = np.flatnonzero((key[1][slot // orders] >= 0) & (mine >= 0))
        common = np.zeros(len(length))
        if len(by) and len(there):
            want = mine[there] * (len(h) + 1) + code[there]
            at = np.minimum(np.searchsorted(place[by], want), len(by) - 1)
            met = place[by][at] == want
            a, b = weight[by[at[met]]], weight[there[met]]
            common = np.bincount(slot[there[met]], np.minimum(a, b) * b, len(length))
        product = length.reshape(-1, orders) * np.where(asks[key[0]] >= 0, 1, 0)[:, None] * length.reshape(-1, orders)[asks[key[0]]]
        cosines = np.divide(common.reshape(-1, orders), product, out=np.zeros_like(product), where=product > 0).sum(axis=1)

        size = pa.compute.list_value_length(words).to_numpy(zero_copy_only=False).astype(float)  # nan without a text
        by = np.lexsort((~pred, id_))
        ids, out = np.split(by, np.flatnonzero(np.diff(id_[by])) + 1), {}
        for own in ids:
            p, r = own[pred[own]], own[~pred[own]]
            if not len(p) or not len(r):
                continue
            total = n = 0
            for s, times in zip(*np.unique(size[p][~np.isnan(size[p])], return_counts=True)):
                apart = s - size[r][~np.isnan(size[r])]
                total += times * float((cosines[group[r][~np.isnan(size[r])]] * np.exp(-(apart * apart) / (2 * LENGTH_SPREAD * LENGTH_SPREAD))).sum())
                n += times * len(apart)
            out[int(p[0])] = 10 * total / n / orders if n else None
        return pa.table({"id": texts.column("id").take(pa.array(list(out), pa.int64())), "cider": pa.array(list(out.values()), pa.float64())})

    return run


def cider(preds: DataFrame, refs: DataFrame, id_col: str, ref_col: str, text: str, orders: int = 4) -> DataFrame:
    """(id, cider) of predictions (id, text) against the references (id, ref, text) of the same id, ten at best.

    N-grams of 1 to orders words are weighed by their count and the log of how few reference sets hold them. For each order and reference: the cosine of both weights, in which
    a prediction's weight counts up to the reference's, times a normal curve of the difference of lengths. The score is the mean over orders and references. An id without a
    prediction has no row, one without references none either. Texts are dealt to tasks by id, so that a task has the n-grams of about TASK_BYTES, and at least one id's.
    Of n-grams only 128-bit hashes with counts are shuffled, one a part, and those that several ids have go back to the parts; an id's texts are scored where they are."""
    spark = preds.sparkSession
    small_batches(spark)
    p = preds.select(F.col(id_col).alias("id"), F.lit(True).alias("pred"), F.col(text).alias("text"))
    r = refs.select(F.col(id_col).alias("id"), F.lit(False).alias("pred"), F.col(text).alias("text"), F.col(ref_col).alias("ref"))
    rows = staged(p.unionByName(r, allowMissingColumns=True).where("id is not null"), "cider-texts")
    octets, sets = rows.agg(F.sum(F.octet_length("text").cast("long")), F.count_distinct(F.when(~F.col("pred"), F.col("id")))).first()
    parts = max(1, -(-(octets or 0) // TASK_BYTES))
    dealt = rows.select("id", "ref", "pred", tokens(F.col("text")).alias("w"), F.pmod(F.hash("id"), F.lit(parts)).alias("part")).repartition(parts, "id")
    counts = dealt.select("id", "pred", "w", "part").mapInArrow(_set_counts(orders), "part int, high long, low long, n long")
    df = F.sum("n").over(Window.partitionBy("high", "low"))  # a row for each part at most
    known = counts.withColumn("df", df).where("df > 1").select("part", "high", "df")
    kind = preds.schema[id_col].dataType
    scored = dealt.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_cider_scores(orders, sets), f"id {rows.schema['id'].dataType.simpleString()}, cider double")
    return scored.select(F.col("id").cast(kind).alias("id"), "cider")


def span_error(rows: DataFrame, clip: str, frame: str, error: str, part: str, ratio: float) -> DataFrame:
    """(clip, ade, fde): mean and last error over a part of each clip of n frames: `after` the first floor(ratio n), `between` as many at both ends, or `all`."""
    n = F.count("*").over(Window.partitionBy(clip))
    r = rows.withColumn("_cut", F.floor(n * F.lit(ratio))).withColumn("_n", n)
    inside = {"all": F.lit(True), "after": F.col(frame) >= F.col("_cut"), "between": (F.col(frame) >= F.col("_cut")) & (F.col(frame) < F.col("_n") - F.col("_cut"))}
    if part not in inside:
        raise ValueError(f"{part!r} is none of {sorted(inside)}")
    return r.where(inside[part] & F.col(error).isNotNull()).groupBy(clip).agg(F.avg(error).alias("ade"), F.max_by(error, frame).alias("fde"))
