"""Operator 5: exact top-k by integer inner product, with multi-resolution segment statistics.

A vector is cut into 1, 4 and then 16 segments; of each segment its mean and deviation are kept. From those alone, the distance
of two vectors has the lower bound sum(l ((m - m')^2 + (s - s')^2)) over segments of length l. With
q v = (|q|^2 + |v|^2 - d^2) / 2 that is an upper bound sum(l (m m' + s s')) on the inner product. A query's rows go through the
bounds coarse to fine; what may still reach its k-th best is computed exactly.

Queries are taken in blocks of about BLOCK_BYTES (a bounded matrix that is broadcast), and each block passes over
all rows once; a task keeps only the k best of each query, which are merged after. No row is shipped for a pair. Within a task a block is
compared QUERIES by ROWS at a time.

Cases: vectors that are null, empty, or hold null or non-finite components take no part; vectors of different lengths don't compare. Ties: smaller id.
An id stands for all its rows: the score of two ids is the best of their rows' scores, an id with several vectors asks with each, and its own
rows are not its candidates. Fewer ids than k: all. Scores beyond 64 bits are cut to that range. Null ids take no part. Extra columns don't matter. Empty table: empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velora.llm.lsh_search import _matrix, usable
from velora.llm.staging import staged

TOP = 5
SCALE = 256
QUERIES, ROWS = 2048, 512
BLOCK_BYTES = 16 << 20
LEVELS = (1, 4, 16)
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Weighted means and deviations, so that the product of two such rows is the bound. Rounded outward by the caller."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    out = [np.sqrt(p.shape[1]) * f(p) for p in parts for f in (lambda p: p.mean(1), lambda p: p.std(1))]
    return np.column_stack(out)


class Best:
    """The k best rows of each query so far, each of another id."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.x, self.ids, self.k = queries, ids, k
        self.levels = [statistics(queries, s) for s in LEVELS]
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), -1, np.int64)
        self.limit = float(np.abs(queries).max(initial=0)) * queries.shape[1]

    def add(self, v: np.ndarray, ids: np.ndarray) -> None:
        """v: integers as doubles, exact if all products stay below 2**53, which the caller sees to."""
        worst = self.score[:, -1:]
        may = self.ids[:, None] != ids[None, :]
        for q, s in zip(self.levels, LEVELS):
            if not np.isfinite(worst).all():
                break
            bound = q @ statistics(v, s).T
            may &= bound * (1 + 1e-9) + 1e-6 * (1 + np.abs(bound)) >= worst
            if not may.any():
                return
        rows = np.flatnonzero(may.any(1))
        cols = np.flatnonzero(may.any(0))
        part, names = may[np.ix_(rows, cols)], ids[cols]
        if part.mean() < 0.02:
            i, j = np.nonzero(part)
            value = (self.x[rows[i]] * v[cols[j]]).sum(1)
        else:
            full = np.where(part, self.x[rows] @ v[cols].T, -np.inf)
            order = np.argsort(names, kind="stable")  # the best of each id, so that repeated rows don't fill a block's k places
            names, first = np.unique(names[order], return_index=True)
            if len(names) < len(order):
                full = np.maximum.reduceat(full[:, order], first, axis=1)
            else:
                full = full[:, order]
            floor = worst[rows]
            if len(names) > self.k:  # what is below this block's own k-th best can't stay either; ties do
                floor = np.maximum(floor, np.partition(full, len(names) - self.k, axis=1)[:, len(names) - self.k, None])
            i, j = np.nonzero((full > -np.inf) & (full >= floor))
            value = full[i, j]
        i = rows[i]
        touched = np.unique(i)
        i = np.concatenate([i, np.repeat(touched, self.k)])
        value = np.concatenate([value, self.score[touched].ravel()])
        found = np.concatenate([names[j], self.found[touched].ravel()])
        order = np.lexsort((-value, found, i))
        i, value, found = i[order], value[order], found[order]
        again = np.zeros(len(i), bool)
        again[1:] = (i[1:] == i[:-1]) & (found[1:] == found[:-1]) & np.isfinite(value[1:])  # another row of the id, no better
        i, value, found = i[~again], value[~again], found[~again]
        order = np.lexsort((found, -value, i))
        i, value, found = i[order], value[order], found[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        nth = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
        keep = nth < self.k
        self.score[i[keep], nth[keep]], self.found[i[keep], nth[keep]] = value[keep], found[keep]


def _exactly(x: np.ndarray, q_ids: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int):
    """For components so large that doubles aren't exact: Python's integers."""
    v_int = [[int(c) for c in row] for row in v]
    for row, me in zip(x, q_ids):
        q_int = [int(c) for c in row]
        best: dict = {}  # of each id
        for w, i in zip(v_int, ids):
            if i != me:
                s = sum(a * b for a, b in zip(q_int, w))
                best[int(i)] = max(best.get(int(i), s), s)
        for s, i in sorted((-s, i) for i, s in best.items())[:k]:
            yield int(me), i, min(max(-s, _LOW), _HIGH)


def _scan(shared, k: int):
    def run(batches):
        best, odd = {}, []
        for b in batches:
            for own, x in _matrix(b.column(1)):
                if (asked := shared.value.get(x.shape[1])) is None:
                    continue
                ids, x = b.column(0).to_numpy()[own], np.floor(SCALE * x)
                if x.shape[1] not in best:
                    best[x.shape[1]] = [Best(asked[0][lo : lo + QUERIES], asked[1][lo : lo + QUERIES], k) for lo in range(0, len(asked[1]), QUERIES)]
                for lo in range(0, len(x), ROWS):
                    part, mine = x[lo : lo + ROWS], ids[lo : lo + ROWS]
                    widest = np.abs(part).max(initial=0)
                    for state in best[x.shape[1]]:
                        if state.limit * widest < 2**52:
                            state.add(part, mine)
                        else:
                            odd += _exactly(state.x, state.ids, part, mine, k)
                            odd = odd if len(odd) < 100_000 else _cut(odd, k)
        q, v, s = zip(*odd) if odd else ((), (), ())
        yield pa.record_batch([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])
        for state in (state for states in best.values() for state in states):
            own = np.isfinite(state.score)
            yield pa.record_batch([pa.array(np.repeat(state.ids, own.sum(1))), pa.array(state.found[own]), pa.array(state.score[own].astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def _cut(rows: list, k: int) -> list:
    out: dict = {}
    for q, v, s in sorted(set(rows), key=lambda r: (r[0], -r[2], r[1])):
        if len(out.setdefault(q, {})) < k:
            out[q].setdefault(v, (q, v, s))
    return [r for x in out.values() for r in x.values()]


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row that is_query (an expression on id_col) admits."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    asks = rows.where("asks").select("id", "vector").distinct()
    size = asks.agg(F.sum(8 * F.size("vector").cast("long"))).first()[0] or 0
    number = max(1, -(-size // BLOCK_BYTES))
    asks = staged(asks.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(number))), "segment-queries")
    found = []
    for block in range(number):
        got = asks.where(F.col("block") == block).select("id", "vector").toArrow().combine_chunks()  # about BLOCK_BYTES
        parts = {}
        if got.num_rows:
            ids = got.column(0).combine_chunks().to_numpy()
            for own, x in _matrix(got.column(1).combine_chunks()):
                parts[x.shape[1]] = (np.floor(SCALE * x), ids[own])
        out = rows.select("id", "vector").mapInArrow(_scan(spark.sparkContext.broadcast(parts), top), "query_id long, vec_id long, score long")
        found.append(staged(out, "segment-found") if number > 1 else out)
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = reduce(DataFrame.union, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(ranked))
    return out.where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
