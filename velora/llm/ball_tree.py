"""Operator 12: hard negatives by branch and bound in ball trees.

A score is the integer inner product of two vectors of floor(SCALE * x). An anchor's positives are its best rows of the same label; for each positive, its negatives are the
best rows of another label whose score lies in a window set by the positive's score. Both searches are the same: rows are dealt to shards of SHARD_BYTES, and each
shard is a ball tree. A ball of centre c and radius r bounds the scores of all its rows with a query q both ways, q c - |q| r and q c + |q| r. A ball is left out if all its
scores lie beneath or above the window, or strictly beneath the query's current k-th best (ties count: the smaller id wins), or if its labels can't serve.
Queries descend a tree together, those that a ball can still serve.

Scale: queries come in blocks of BLOCK_BYTES, and shards and blocks form a grid whose cells are dealt out in one job; a task keeps the k best of a block over all its shards. Nothing goes
through the driver or is broadcast. Sizes are in bytes, so memory doesn't depend on the length of vectors. Scores whose products could leave the range
where doubles are exact are computed in Python's integers, without a tree.

Cases: rows with a null id, a null label, a null or empty vector, or a null or non-finite component take no part; vectors of different lengths don't compare. Rows alike in id, label and
vector count once. An id with several different rows is several rows: each is an anchor, a positive or a negative of its own, but no row of the anchor's own id counts for it. Scores beyond 64 bits
are cut to that range. A window of a negative positive score is empty. Fewer rows than asked for: all. Extra columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velora.llm.lsh_search import usable
from velora.llm.staging import staged
from velora.llm.words import tidy

POSITIVES, NEGATIVES = 5, 10
#: Least and most share of the positive's score, in hundredths.
LOW, HIGH = 30, 90
SCALE = 256
SHARD_BYTES, BLOCK_BYTES = 2 << 20, 1 << 20
LEAF = 64
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class BallTree:
    """Rows in order of their leaves; node 0 is the root. A node's children are nodes, or it is a leaf of rows lo to hi."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        order, self.nodes = np.arange(len(x)), []
        centre, radius = [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            own = order[lo:hi]
            points = x[own]
            c = points.mean(0)
            away = ((points - c) ** 2).sum(1)
            centre.append(c), radius.append(np.sqrt(away.max()))
            node = [lo, hi, -1, -1, labels[own].min(), labels[own].max()]
            if parent >= 0:
                self.nodes[parent][2 + side] = len(self.nodes)
            self.nodes.append(node)
            if hi - lo > LEAF:  # halves along the line between two rows that are far apart
                a = points[away.argmax()]
                b = points[((points - a) ** 2).sum(1).argmax()]
                half = (hi - lo) // 2
                order[lo:hi] = own[np.argpartition(points @ (b - a), half)]
                me = len(self.nodes) - 1
                todo += [(lo, lo + half, me, 0), (lo + half, hi, me, 1)]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.norm = np.sqrt((self.centre**2).sum(1))
        self.x, self.ids, self.labels = x[order], ids[order], labels[order]


class Search:
    """A block of queries (vectors of whole numbers), each with its k best rows so far: of its own label or of others, with scores from low to high."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: list[int], high: list[int], k: int, same: bool):
        self.q, self.ids, self.labels, self.k, self.same = q, ids, labels, k, same
        self.low_int, self.high_int = low, high
        self.low, self.high = np.array(low, np.float64), np.array(high, np.float64)
        self.norm = np.sqrt((q * q).sum(1))
        self.widest = float(np.abs(q).max(initial=0)) * q.shape[1]
        self.score, self.found = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
        self.odd: list[list[tuple[int, int]]] = [[] for _ in q]

    def add(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        if self.widest * float(np.abs(x).max(initial=0)) >= 2**52:
            return self._exactly(x, ids, labels)
        tree = BallTree(x, ids, labels)
        todo = [(0, np.arange(len(self.q)))]
        while todo:
            node, alive = todo.pop()
            alive = alive[self._may(tree, node, alive)]
            if not len(alive):
                continue
            lo, hi, left, right, _, _ = tree.nodes[node]
            if left < 0:
                self._leaf(tree, lo, hi, alive)
            else:  # the likelier child on top
                near = (self.q[alive] @ (tree.centre[left] - tree.centre[right])).sum() > 0
                todo += [(right, alive), (left, alive)] if near else [(left, alive), (right, alive)]

    def _may(self, tree: BallTree, node: int, alive: np.ndarray) -> np.ndarray:
        least, most = tree.nodes[node][4:]
        mine = self.labels[alive]
        ok = (mine >= least) & (mine <= most) if self.same else (mine != least) | (mine != most)
        middle = self.q[alive] @ tree.centre[node]
        reach = self.norm[alive] * tree.radius[node]
        reach += 1e-9 * (reach + self.norm[alive] * tree.norm[node]) + 1e-6  # rounding
        top = middle + reach
        return ok & (top >= self.low[alive]) & (middle - reach <= self.high[alive]) & (top >= self.score[alive, -1])

    def _leaf(self, tree: BallTree, lo: int, hi: int, alive: np.ndarray) -> None:
        value = self.q[alive] @ tree.x[lo:hi].T
        alike = self.labels[alive][:, None] == tree.labels[lo:hi][None, :]
        fit = (alike if self.same else ~alike) & (self.ids[alive][:, None] != tree.ids[lo:hi][None, :])
        fit &= (value >= np.maximum(self.low[alive], self.score[alive, -1])[:, None]) & (value <= self.high[alive][:, None])
        i, j = np.nonzero(fit)
        if not len(i):
            return
        touched = np.unique(i)
        who = np.concatenate([alive[i], np.repeat(alive[touched], self.k)])
        score = np.concatenate([value[i, j], self.score[alive[touched]].ravel()])
        found = np.concatenate([tree.ids[lo:hi][j], self.found[alive[touched]].ravel()])
        by = np.lexsort((found, -score, who))
        who, score, found = who[by], score[by], found[by]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        nth = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        keep = nth < self.k
        self.score[who[keep], nth[keep]], self.found[who[keep], nth[keep]] = score[keep], found[keep]

    def _exactly(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        rows = [[int(c) for c in r] for r in x]
        for i, q in enumerate(self.q):
            whole, mine = [int(c) for c in q], self.odd[i]
            for r, name, label in zip(rows, ids.tolist(), labels.tolist()):
                if name != self.ids[i] and (label == self.labels[i]) == self.same:
                    s = min(max(sum(a * b for a, b in zip(whole, r)), _LEAST), _MOST)
                    if self.low_int[i] <= s <= self.high_int[i]:
                        mine.append((-s, name))
            mine.sort()
            del mine[self.k :]

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place of the query, row id, score)"""
        own = np.isfinite(self.score)
        yield np.repeat(np.arange(len(self.q)), own.sum(1)), self.found[own], self.score[own].astype(np.int64)
        odd = [(i, name, -s) for i, mine in enumerate(self.odd) for s, name in mine]
        if odd:
            yield tuple(np.array(c, np.int64) for c in zip(*odd))


def _vectors(column: pa.Array) -> list[np.ndarray]:
    at = column.offsets.to_numpy()
    flat = np.floor(SCALE * column.values.to_numpy(zero_copy_only=False).astype(np.float64))
    return [flat[a:b] for a, b in zip(at, at[1:])]


def _cells(batches) -> Iterator[tuple[tuple, list, list]]:
    """(block and shard, queries, rows) of each cell, from rows (block, shard, role, key, id, label, positive, vector) in that order."""
    now, parts = None, ([], [])
    for b in batches:
        for block, shard, role, *rest in zip(*(b.column(i).to_pylist() for i in range(7)), _vectors(b.column(7))):
            if (block, shard) != now:
                if now is not None:
                    yield now, *parts
                now, parts = (block, shard), ([], [])
            parts[role].append(rest)
    if now is not None:
        yield now, *parts


def _by_length(rows: list) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(len(r[-1]), []).append(r)
    return out


def _searched(k: int, same: bool, low: int, high: int):
    def ready(queries: list) -> dict[int, tuple]:
        out = {}
        for size, rows in _by_length(queries).items():
            key, ids, labels, positive, vectors = zip(*rows)
            lows, highs = ([_LEAST] * len(rows), [_MOST] * len(rows)) if same else ([-(-low * p // 100) for p in positive], [high * p // 100 for p in positive])
            out[size] = np.array(key), Search(np.array(vectors), np.array(ids), np.array(labels), lows, highs, k, same)
        return out

    def done(searches: dict[int, tuple]):
        for key, search in searches.values():
            for q, ids, score in search.rows():
                yield pa.record_batch([pa.array(key[q]), pa.array(ids), pa.array(score)], names=["key", "found", "score"])

    def run(batches):
        block, searches = None, {}
        for (now, _), queries, rows in _cells(batches):
            if now != block:  # each cell of a block has the same queries
                yield from done(searches)
                block, searches = now, ready(queries)
            for size, own in _by_length(rows).items():
                if size in searches:
                    _, ids, labels, _, vectors = zip(*own)
                    searches[size][1].add(np.array(vectors), np.array(ids), np.array(labels))
        yield from done(searches)

    return tidy(run)


def _best(rows: DataFrame, shards: int, queries: DataFrame, k: int, same: bool, low: int, high: int) -> DataFrame:
    """(key, found, score): the k best of all shards for each of queries (key, id, label, positive, vector)."""
    blocks = max(1, -(-(queries.agg(F.sum(8 * F.size("vector").cast("long"))).first()[0] or 0) // BLOCK_BYTES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("long")
    asked = queries.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    held = rows.withColumn("shard", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    names = ["key", "id", "label", "positive", "vector"]
    asked = asked.select("block", "shard", F.lit(0).alias("role"), *names)
    held = held.select("block", "shard", F.lit(1).alias("role"), none.alias("key"), "id", "label", none.alias("positive"), "vector")
    dealt = asked.union(held).repartition("block", "shard").sortWithinPartitions("block", "shard", "role")
    found = dealt.mapInArrow(_searched(k, same, low, high), "key long, found long, score long")
    ranked = Window.partitionBy("key").orderBy(F.col("score").desc(), "found")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row that is_anchor admits; label and is_anchor are expressions on df.

    Negatives score from low to high hundredths of the positive's score."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))).distinct()
    rows = staged(rows.withColumn("key", F.monotonically_increasing_id()), "ball-rows")
    shards = max(1, -(-(rows.agg(F.sum(8 * F.size("vector").cast("long"))).first()[0] or 0) // SHARD_BYTES))
    anchors = rows.where("asks").select("key", "id", "label", F.lit(None).cast("long").alias("positive"), "vector")
    first = _best(rows, shards, anchors, positives, True, low, high)
    first = staged(first.select(F.col("key").alias("a_key"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("p_rank")), "ball-positives")
    asked = first.where("positive_score >= 0").join(anchors.select(F.col("key").alias("o_key"), "id", "label", "vector"), F.col("a_key") == F.col("o_key"))
    asked = asked.select("a_key", F.col("id").alias("anchor_id"), "positive_id", "positive_score", "label", "vector").withColumn("key", F.monotonically_increasing_id())
    asked = staged(asked, "ball-windows")
    best = _best(rows, shards, asked.select("key", F.col("anchor_id").alias("id"), "label", F.col("positive_score").alias("positive"), "vector"), negatives, False, low, high)
    best = staged(best.select(F.col("key").alias("b_key"), "found", "score", "rank"), "ball-negatives")
    out = asked.join(best, F.col("key") == F.col("b_key"))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
