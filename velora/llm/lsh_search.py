"""Operator 4: approximate nearest neighbours by cosine with multiprobe p-stable hashing.

On unit vectors Euclidean distance and cosine order alike, so each of TABLES tables hashes a unit vector with FUNCTIONS
functions floor((a x + b) / WIDTH) of Gaussian a. A query visits its own bucket and the PROBES perturbed buckets
whose boundaries are nearest in sum of squares, which is the estimated order of success. The candidates of
all tables are ranked by their exact cosine in double precision.

Every row is indexed; nothing is fitted. Equal vectors are one candidate with its TOP + 1 smallest ids (no more can be among
a query's TOP), so a vector that a third of all rows share makes no more pairs than any other. A bucket's, a task's and the final choice keep
the TOP + 1 best ids of a query, each by its best vector, so that an id with many rows takes one place. Buckets are dealt out in
shards of about SHARD vectors; a query's vector goes once to each shard with some of its buckets. A bucket over SHARD vectors is split,
and so are its queries if they are more than SHARD: the bucket becomes a grid of bounded cells, and all of them are searched.

Recall against brute force on uniformly random directions, the hardest case, is in the README.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part. Vectors of different lengths are never
neighbours. Ties: smaller id. Fewer candidates than TOP: all that were found. An id stands for all its rows: it asks with each of its vectors, its
score is the best of them, and its own rows are not its candidates. Null ids take no part. Extra columns don't matter. Empty table: empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velora.llm.staging import staged
from velora.operators.corpus import placed

TOP = 5
TABLES, FUNCTIONS, WIDTH, PROBES, SEED = 8, 8, 2.0, 110, 11
SHARD = 4096
CELL = 1 << 21  # products that are held at once
HELD = 1 << 19  # results of a task before it keeps only each query's best of them


def usable(vector: Column) -> Column:
    """Neither null nor empty, only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


class Family:
    """The hash functions of one table for vectors of one length."""

    def __init__(self, dim: int, table: int, functions: int, width: float):
        rng = np.random.default_rng((SEED, dim, table))
        self.a, self.b, self.width = rng.normal(size=(dim, functions)), rng.uniform(0, width, functions), width
        self.mix = rng.integers(1, 1 << 62, functions, dtype=np.int64) | 1

    def project(self, unit: np.ndarray) -> np.ndarray:
        return (unit @ self.a + self.b) / self.width

    def key(self, cells: np.ndarray) -> np.ndarray:
        """A 64-bit name of a bucket."""
        with np.errstate(over="ignore"):
            h = (cells.astype(np.int64) * self.mix).sum(-1)
            return (h ^ (h >> 29)) * np.int64(0x1B873593CC9E2D51)


def probes(position: np.ndarray, count: int) -> np.ndarray:
    """The cell of a query and its count likeliest neighbours, in order of estimated success."""
    cell = np.floor(position).astype(np.int64)
    inside = position - cell
    m = len(cell)
    steps = sorted([(inside[j] ** 2, j, -1) for j in range(m)] + [((1 - inside[j]) ** 2, j, 1) for j in range(m)])
    cost = [s[0] for s in steps]
    out, queue = [cell], [(cost[0], (0,))]
    while queue and len(out) <= count:
        score, chosen = heapq.heappop(queue)
        if len({steps[k][1] for k in chosen}) == len(chosen):  # not both ways along one axis
            near = cell.copy()
            for k in chosen:
                near[steps[k][1]] += steps[k][2]
            out.append(near)
        last = chosen[-1]
        if last + 1 < len(steps):  # replace the last step by the next, or add the next
            heapq.heappush(queue, (score - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(queue, (score + cost[last + 1], (*chosen, last + 1)))
    return np.array(out)


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors in double) for each length that occurs."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.concatenate(([0], np.cumsum(sizes)))
    return [(own := np.flatnonzero(sizes == d), flat[start[own][:, None] + np.arange(d)]) for d in np.unique(sizes)]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash_rows(tables: int, functions: int, width: float):
    """(rep, ids, vector) to (dim, hash table, bucket, rep, ids, vector), one row a table."""

    def run(batches):
        for b in batches:
            for own, x in _matrix(b.column(2)):
                unit, d = _unit(x), x.shape[1]
                for t in range(tables):
                    f = Family(d, t, functions, width)
                    yield pa.record_batch([pa.array(np.full(len(own), d * tables + t)), pa.array(f.key(np.floor(f.project(unit)))), *(c.take(pa.array(own)) for c in b.columns)], names=["tab", "bucket", "rep", "ids", "vector"])

    return run


def _probe_rows(tables: int, functions: int, width: float, count: int):
    def run(batches):
        for b in batches:
            for own, x in _matrix(b.column(1)):
                unit, d = _unit(x), x.shape[1]
                for t in range(tables):
                    f = Family(d, t, functions, width)
                    keys = [np.unique(f.key(probes(p, count))) for p in f.project(unit)]
                    n = [len(k) for k in keys]
                    yield pa.record_batch([pa.array(np.full(sum(n), d * tables + t)), pa.array(np.concatenate(keys)), b.column(0).take(pa.array(np.repeat(own, n)))], names=["tab", "bucket", "rep"])

    return run


def _search(top: int):
    """Rows (tab, shard, split, row, role, rep, bucket list, ids, vector) by cell, queries (role 0) first: each query's nearest ids in its buckets."""

    def nearest(queries, rows):
        """(query, id, cosine): the best of each bucket that a query visits."""
        q_rep, q_buckets, q = np.array([r[0] for r in queries]), [r[1] for r in queries], np.array([r[3] for r in queries], np.float64)
        v_bucket, v = np.array([r[1][0] for r in rows]), np.array([r[3] for r in rows], np.float64)
        n_ids = np.array([len(r[2]) for r in rows])
        ids, row_of = np.concatenate([np.array(r[2], np.int64) for r in rows]), np.repeat(np.arange(len(rows)), n_ids)
        first_id = np.cumsum(n_ids) - n_ids
        once = len(np.unique(ids)) == len(ids)  # no id has two vectors here
        q_norm, v_norm = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
        order = np.argsort(v_bucket, kind="stable")
        names, start = np.unique(v_bucket[order], return_index=True)
        end = np.append(start[1:], len(order))
        asked, who = np.concatenate([np.array(x) for x in q_buckets]), np.repeat(np.arange(len(q)), [len(x) for x in q_buckets])
        at = np.searchsorted(names, asked)
        hit = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == asked)
        at, who = at[hit], who[hit]
        by = np.argsort(at, kind="stable")
        at, who = at[by], who[by]
        found_q, found_v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        k = 2 * top + 2  # a margin for the rounding of the product
        for lo, hi in zip(np.flatnonzero(np.diff(at, prepend=-1)), np.append(np.flatnonzero(np.diff(at)) + 1, len(at))[: len(at)]):
            mine, those = who[lo:hi], order[start[at[lo]] : end[at[lo]]]
            few = max(1, CELL // (len(those) if once else int(n_ids[those].sum())))
            for part in (mine[j : j + few] for j in range(0, len(mine), few)):
                s = (q[part] @ v[those].T) / np.outer(q_norm[part], v_norm[those])
                if once:
                    near = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(those) else np.broadcast_to(np.arange(len(those)), (len(part), len(those)))
                    found_q.append(np.repeat(part, near.shape[1])), found_v.append(those[near].ravel())
                else:
                    i, j = _best_of_ids(s, n_ids[those], np.concatenate([ids[first_id[r] : first_id[r] + n_ids[r]] for r in those]), k)
                    found_q.append(part[i]), found_v.append(those[j])
        fq, fv = np.concatenate(found_q), np.concatenate(found_v)
        exact = (q[fq] * v[fv]).sum(1) / (q_norm[fq] * v_norm[fv])
        n = n_ids[fv]
        every = np.repeat(first_id[fv] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return best(np.repeat(q_rep[fq], n), ids[every], np.repeat(exact, n))

    def best(q, ids, score):
        """Each query's top + 1 ids by their best score."""
        by = np.lexsort((-score, ids, q))
        q, ids, score = q[by], ids[by], score[by]
        once = np.ones(len(q), bool)
        once[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        q, ids, score = q[once], ids[once], score[once]
        by = np.lexsort((ids, -score, q))
        q, ids, score = q[by], ids[by], score[by]
        first = np.flatnonzero(np.diff(q, prepend=q[0] - 1)) if len(q) else np.empty(0, int)
        keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) <= top
        return q[keep], ids[keep], score[keep]

    def run(batches):
        now, queries, rows, held, size = None, [], [], [], 0
        for b in _and_end(batches):
            keys = [None] if b is None else list(zip(*[b.column(k).to_pylist() for k in range(4)]))
            if b is not None:
                roles, reps, buckets, ids = (b.column(k).to_pylist() for k in (4, 5, 6, 7))
                vectors = b.column(8)
                places, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            for i, key in enumerate(keys):
                if key != now or len(rows) >= 2 * SHARD:  # a shard's rows need not be held all at once
                    if queries and rows:
                        held.append(nearest(queries, rows))
                        size += len(held[-1][0])
                    queries, rows = (queries if key == now else []), []
                    now = key
                if size >= HELD:  # shards of one task share queries: send each query's best of all of them
                    held = [best(*[np.concatenate(x) for x in zip(*held)])]
                    size = len(held[0][0])
                    if size >= HELD // 2:
                        yield _rows(held)
                        held, size = [], 0
                if b is not None:
                    (rows if roles[i] else queries).append((reps[i], buckets[i], ids[i], flat[places[i] : places[i + 1]].copy()))
        if held:
            yield _rows([best(*[np.concatenate(x) for x in zip(*held)])])

    return run


def _best_of_ids(s: np.ndarray, n_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the rows that are the best of one of a query's k best ids, to within rounding. s: cosines of queries and rows; ids: n_ids of each row."""
    order = np.argsort(ids, kind="stable")
    row = np.repeat(np.arange(len(n_ids)), n_ids)[order]
    names, first = np.unique(ids[order], return_index=True)
    each = s[:, row]
    best = np.maximum.reduceat(each, first, axis=1)
    floor = np.partition(best, len(names) - k, axis=1)[:, len(names) - k, None] if len(names) > k else -np.inf
    i, j = np.nonzero((each >= floor - 1e-9) & (each >= np.repeat(best, np.diff(np.append(first, len(row))), axis=1) - 1e-9))
    pair = np.unique(i * s.shape[1] + row[j])
    return pair // s.shape[1], pair % s.shape[1]


def _and_end(batches):
    yield from batches
    yield None


def _rows(held: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(held[0][0]), pa.array(held[0][1]), pa.array(held[0][2])], names=["q", "id", "score"])


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, count: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query (an expression on id_col) admits its nearest other rows."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = rows.where(F.exists("vector", lambda x: x != 0)).distinct()
    # equal vectors are one, named by its place in the order of their smallest ids; top + 1 ids are all that can matter
    of = rows.groupBy("vector").agg(F.min("id").alias("least"), F.max("asks").alias("asked"))
    of = placed(of, ["least"], "rep").select("rep", "vector", "asked")
    small = rows.withColumn("k", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("k") <= top + 1)
    small = small.groupBy(F.col("vector").alias("i_vector")).agg(F.array_sort(F.collect_list("id")).alias("ids"))  # at most top + 1 of each
    small = of.join(small, F.col("vector") == F.col("i_vector")).select(F.col("rep").alias("i_rep"), "ids")
    shards = max(1, -(-of.count() // SHARD))
    held = of.join(small, F.col("rep") == F.col("i_rep")).select("rep", "ids", "vector")
    index = staged(held.mapInArrow(_hash_rows(tables, functions, width), _schema(of, "tab long, bucket long, rep long, ids array<long>")), "lsh-index")
    asked = of.where("asked").select("rep", "vector")
    probed = staged(asked.mapInArrow(_probe_rows(tables, functions, width, count), "tab long, bucket long, rep long"), "lsh-probes")
    # of buckets over SHARD: into how many parts rows and queries go
    wide = index.groupBy("tab", "bucket").count().where(F.col("count") > SHARD).select(F.col("tab").alias("w_tab"), F.col("bucket").alias("w_bucket"), F.ceil(F.col("count") / SHARD).alias("splits"))
    in_wide = (F.col("tab") == F.col("w_tab")) & (F.col("bucket") == F.col("w_bucket"))
    visits = probed.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / SHARD).alias("rows"))
    wide = staged(wide.join(visits, in_wide, "left").select("w_tab", "w_bucket", "splits", F.coalesce("rows", F.lit(1).cast("long")).alias("rows")), "lsh-wide-buckets")
    shard = F.pmod(F.xxhash64("bucket"), F.lit(shards))
    parts = lambda name: F.coalesce(name, F.lit(1).cast("long"))
    own = lambda name: F.pmod(F.xxhash64("rep", F.lit(1)), parts(name))
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), parts(name) - 1))
    cell = ["tab", "shard", "split", "row"]
    held = index.join(wide, in_wide, "left").select("tab", shard.alias("shard"), own("splits").alias("split"), every("rows").alias("row"), F.lit(1).alias("role"), "rep", F.array("bucket").alias("buckets"), "ids", "vector")
    probed = probed.join(wide, in_wide, "left").select("tab", "bucket", "rep", "splits", own("rows").alias("row")).withColumn("split", every("splits"))
    probed = probed.groupBy("tab", shard.alias("shard"), "split", "row", "rep").agg(F.collect_list("bucket").alias("buckets"))
    probed = probed.join(asked.withColumnRenamed("rep", "a_rep"), F.col("rep") == F.col("a_rep")).select(*cell, F.lit(0).alias("role"), "rep", "buckets", F.lit(None).cast("array<long>").alias("ids"), "vector")
    dealt = held.union(probed).repartition(*cell).sortWithinPartitions(*cell, "role")
    found = dealt.mapInArrow(_search(top), "q long, id long, score double")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    found = found.groupBy("q", "id").agg(F.max("score").alias("score")).withColumn("k", F.row_number().over(best)).where(F.col("k") <= top + 1)
    found = staged(found.select("q", "score", F.col("id").alias("vec_id")), "lsh-found")
    asks = rows.where("asks").join(of.select(F.col("vector").alias("o_vector"), F.col("rep").alias("a_rep")), F.col("vector") == F.col("o_vector")).select(F.col("id").alias("query_id"), "a_rep")
    out = asks.join(found, F.col("a_rep") == F.col("q")).where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _schema(df: DataFrame, head: str) -> str:
    return f"{head}, vector {df.schema['vector'].dataType.simpleString()}"
