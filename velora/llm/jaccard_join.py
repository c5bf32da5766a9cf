"""Operator 7: n-gram Jaccard join by prefix trees.

A document's set holds the 58-bit hashes of its distinct word n-grams in one global order: rare before frequent (by the
power of two of a count over all documents), then by hash. Sets that link share two of their first
n - ceil(t n) + 2 grams. The steps:

1. One pass over the texts: size and digest of each set; grams frequent within a stretch of documents, of which
   the HOT most frequent overall make the order's upper levels. (The order affects speed, never results.)
2. One pass: the prefix of each distinct set, as rows of (gram, set).
3. Lists of sets by gram say which sets have to meet. Short lists give pairs by size and position bounds; a pair counts once two lists
   have given it (a linked pair that doesn't share two grams of short lists shares one of a long list). Of a long list
   every member has to meet the list's leader only: the member that is in most long lists, so that a group of near copies has few leaders.
4. The sets that have to meet are dealt to buckets, and each bucket is joined through a trie: its sets, in the global order, are the paths; all
   probes of the bucket descend together and share the overlap of every common path; a probe leaves a subtree, and a subtree without probes is skipped,
   once the grams that remain on either side can't reach the bound.
5. Components of the links. A long list whose members are all in one component needs no more. In the others, the triangle
   inequality of the Jaccard distance rules out members by their distance to the leader: those that it links are connected, and link with none
   beyond its ring. Where more than FEW_BLOCKS blocks of members are left, they get a leader of their own, PIVOTS times, which connects the clusters that
   share a list; members that are still in different components are then joined in blocks of BLOCK by BLOCK sets. Then components again.

Equal sets are one node, so a group of exact copies makes no pairs at all. A node has 64 bits of a 128-bit digest as its name;
names that two digests share are found and replaced by the other half. Grams are compared within pairs of sets only.

Cases: null or empty text, or no word: empty set, linked with nothing, its own component. Fewer words than n: the
whole sequence is the one gram. Repeated rows: one result row each. A null id takes part in no link of its own. Extra columns don't matter, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velora.llm.components import components
from velora.llm.staging import drop, free, staged, tables
from velora.llm.words import Block, blocks, gram_hashes, gram_starts, tidy

WORDS, PERCENT = 4, 85
HOT, HOT_LOCAL, STRETCH = 1 << 18, 2, 1 << 20
SHORT_LIST, CHUNK, BLOCK = 64, 256, 256
PIVOTS, FEW_BLOCKS = 2, 4
BUCKET = 1024  # sets that a trie holds, about
MOST_CLASHES = 1 << 20  # names that two digests share: a few hundred among 10**11 sets
LEVEL_BITS = 58
SEEN = 1 << 17
FEW = 1 << 21  # ids of eight bytes that may be broadcast
STEP = 64  # nodes of a trie path between two looks at the bound
NAME_BITS = 64
PROBE, MEMBER = 1, 2  # what a set is in a bucket; it may be both


def sets_of(block: Block, n: int) -> list[np.ndarray]:
    """The distinct n-gram hashes of each text of a block, ascending."""
    hashes = block.word_hashes(lower=True)
    start, counts = gram_starts(block.first, n)
    grams = gram_hashes(hashes, start, n) >> np.uint64(64 - LEVEL_BITS)
    edge = np.concatenate(([0], np.cumsum(counts)))
    out = [np.unique(grams[lo:hi]) for lo, hi in zip(edge, edge[1:])]
    few = np.flatnonzero((block.counts > 0) & (block.counts < n))
    if len(few):
        whole = gram_hashes(hashes, block.first[few], block.counts[few]) >> np.uint64(64 - LEVEL_BITS)
        for i, g in zip(few, whole):
            out[i] = np.array([g], np.uint64)
    return out


def digests(grams: np.ndarray, bits: int = NAME_BITS) -> tuple[int, int]:
    """128 bits that name a set, in two halves; the first cut to `bits`."""
    both = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(both[:8], "little", signed=True) >> (NAME_BITS - bits), int.from_bytes(both[8:], "little", signed=True)


@dataclass
class Names:
    """The first half of a digest, or where that is another set's too, the second."""

    clashes: frozenset
    bits: int

    def of(self, grams: np.ndarray) -> int:
        first, second = digests(grams, self.bits)
        return second if first in self.clashes else first


class Order:
    """The global order: frequent grams get a level in their upper bits."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        by = np.argsort(grams)
        self.grams = grams[by].astype(np.uint64)
        self.levels = np.log2(np.maximum(counts[by], 2)).astype(np.uint64) << np.uint64(LEVEL_BITS)
        self.map = np.zeros(1 << 22, bool)
        self.map[(self.grams >> np.uint64(LEVEL_BITS - 22)).astype(np.int64)] = True

    def sort(self, grams: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.map[(grams >> np.uint64(LEVEL_BITS - 22)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.grams, grams[maybe]), len(self.grams) - 1)
            same = self.grams[at] == grams[maybe]
            grams = grams.copy()
            grams[maybe[same]] |= self.levels[at[same]]
            grams.sort()
        return grams


def required(a, b, percent: int):
    """Least overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    """Grams of which a linked set shares two; none if no different set can link."""
    return 0 if 100 * n < percent * (n + 1) else min(n, n - -(-percent * n // 100) + 2)


class Probes:
    """Ordered sets that descend a trie together."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.grams, rank = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_inverse=True)
        self.width = len(self.grams) + 1
        self.keys = owner * self.width + rank  # ascending, as each set is
        by = np.argsort(rank, kind="stable")
        self.holders, self.at = owner[by], np.searchsorted(rank[by], np.arange(self.width))

    def hits(self, nodes: np.ndarray) -> np.ndarray:
        """How many of some nodes each probe holds."""
        at = np.searchsorted(self.grams, nodes)
        at = at[at < len(self.grams)] if len(at) and at[-1] == len(self.grams) else at
        at = at[self.grams[at] == nodes[: len(at)]]
        n = self.at[at + 1] - self.at[at]
        places = np.repeat(self.at[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.holders[places], minlength=len(self.sizes))

    def rest(self, probes: np.ndarray, node: np.uint64) -> np.ndarray:
        """How many grams of each of these probes come after node."""
        after = int(np.searchsorted(self.grams, node, "right"))
        return self.first[probes + 1] - np.searchsorted(self.keys, probes * self.width + after)


class Trie:
    """Ordered sets as the paths of a prefix tree whose chains are runs of one set: sorted, each with the length it shares with the one before."""

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.shared = np.zeros(len(sets), np.int64)
        for i, (a, b) in enumerate(zip(self.sets, self.sets[1:]), 1):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m]) if m and a[0] == b[0] else np.zeros(1, int)
            self.shared[i] = differ[0] if len(differ) else m

    def join(self, sets: list[np.ndarray], percent: int):
        """(set's place, probe, overlap) wherever a set and a probe reach the bound."""
        if not self.sets or not sets:
            return
        probes = Probes(sets)
        open_ = [(0, len(self.sets), 0, np.arange(len(sets)), np.zeros(len(sets), np.int64))]  # subtrees: their sets, depth, probes, overlaps
        while open_:
            lo, hi, depth, live, overlap = open_.pop()
            path, least, most = self.sets[lo], int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max())
            end = int(self.shared[lo + 1 : hi].min()) if hi > lo + 1 else len(path)
            step = STEP
            while depth < end and len(live):
                nodes = path[depth : min(end, depth + step)]
                depth, step = depth + len(nodes), 4 * step
                overlap = overlap + probes.hits(nodes)[live]
                n = probes.sizes[live]
                may = (overlap + most - depth >= required(n, most, percent)) & (overlap + probes.rest(live, nodes[-1]) >= required(n, least, percent))
                live, overlap = live[may], overlap[may]
            if not len(live):
                continue  # the whole subtree can't reach the bound any more
            while lo < hi and self.sizes[lo] == end:  # sets that end here
                own = np.flatnonzero(overlap >= required(probes.sizes[live], end, percent))
                for k in own:
                    yield self.order[lo], int(live[k]), int(overlap[k])
                lo += 1
            if lo < hi:
                cuts = [lo, *(lo + 1 + np.flatnonzero(self.shared[lo + 1 : hi] == end)).tolist(), hi]
                open_ += [(a, b, end, live, overlap) for a, b in zip(cuts, cuts[1:])]


def _scan(n: int, bits: int):
    """Rows of kind 0: a document's size and digest; of kind 1: a frequent gram and its count within a stretch."""

    def run(batches):
        held, seen, size = [], set(), 0

        def frequent():
            grams, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, int))
            own = counts >= HOT_LOCAL
            k = int(own.sum())
            return pa.record_batch([pa.array(np.ones(k, np.int8)), pa.nulls(k, kind), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(grams[own].astype(np.int64)), pa.array(counts[own].astype(np.int64))], names=names)

        names, kind = ["kind", "id", "digest", "other", "x", "y"], pa.int64()
        for b in batches:
            kind = b.column(0).type
            halves, sizes = [], []
            for block in blocks(b.column(1)):
                for grams in sets_of(block, n):
                    d = digests(grams, bits) if len(grams) else None
                    halves.append(d or (None, None)), sizes.append(len(grams))
                    if d is not None and d not in seen:
                        seen.add(d)
                        held.append(grams)
                        size += len(grams)
                if size >= STRETCH:
                    yield frequent()
                    held, seen, size = [], set(), 0
            k = len(halves)
            first, second = (pa.array([h[i] for h in halves], pa.int64()) for i in (0, 1))
            yield pa.record_batch([pa.array(np.zeros(k, np.int8)), b.column(0), first, second, pa.array(sizes, pa.int64()), pa.nulls(k, pa.int64())], names=names)
        yield frequent()

    return tidy(run)


def _prefixes(n: int, percent: int, shared):
    def run(batches):
        (order, named), seen = shared.value, set()
        for b in batches:
            grams, names, places = [], [], []
            for block in blocks(b.column(0)):
                for own in sets_of(block, n):
                    p = prefix(len(own), percent)
                    d = named.of(own) if p > 0 else None
                    if d is None or d in seen:  # a copy of a set that this task has dealt with
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(d)
                    grams.append(order.sort(own)[:p])
                    names.append(np.full(p, d)), places.append(np.arange(p) | len(own) << 32)
            if names:
                yield pa.record_batch([pa.array(np.concatenate(grams).astype(np.int64)), pa.array(np.concatenate(names)), pa.array(np.concatenate(places))], names=["gram", "digest", "place"])

    return tidy(run)


def _candidates(percent: int):
    """From rows (gram, digest, place) sorted by the first two: kind 0: a pair (a, b); kind 1: a gram of a long list and its member b."""

    def made(kind, grams, a, b):
        return pa.record_batch([pa.array(np.full(len(b), kind, np.int8)), pa.array(grams), pa.array(a), pa.array(b)], names=["kind", "gram", "a", "b"])

    def pairs(gram, node, place):
        """All lists are whole."""
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(gram)))
        length = np.repeat(size, size)
        for at, k in zip(first[size > SHORT_LIST], size[size > SHORT_LIST]):
            yield made(1, gram[at : at + k], node[at : at + k], node[at : at + k])
        short = np.flatnonzero((length > 1) & (length <= SHORT_LIST))
        g, m, p = gram[short], place[short] >> 32, place[short] & 0xFFFFFFFF
        for shift in range(1, SHORT_LIST):
            i = np.flatnonzero(g[shift:] == g[:-shift])
            if not len(i):
                break
            j = i + shift
            bound = 2 + np.minimum(m[i] - p[i] - 1, m[j] - p[j] - 1)  # if this is the first or second gram that they share
            own = np.minimum(bound, np.minimum(m[i], m[j])) >= required(m[i], m[j], percent)
            if own.any():
                yield made(0, g[i[own]], node[short[i[own]]], node[short[j[own]]])

    def run(batches):
        rest, long_gram = None, None
        for b in batches:
            t = [b.column(k).to_numpy() for k in range(3)]
            if rest is not None:
                t = [np.concatenate(x) for x in zip(rest, t)]
            if not len(t[0]):
                continue
            fresh = np.ones(len(t[0]), bool)  # the same set can come from several tasks
            fresh[1:] = (t[0][1:] != t[0][:-1]) | (t[1][1:] != t[1][:-1])
            t = [x[fresh] for x in t]
            if long_gram is not None:
                k = int(np.searchsorted(t[0], long_gram, "right"))
                if k:
                    yield made(1, t[0][:k], t[1][:k], t[1][:k])
                    t = [x[k:] for x in t]
                if not len(t[0]):
                    continue
                long_gram = None
            last = int(np.searchsorted(t[0], t[0][-1], "left"))
            yield from pairs(*[x[:last] for x in t])
            rest = [x[last:] for x in t]
            if len(rest[0]) > SHORT_LIST:
                long_gram = rest[0][0]
                yield made(1, rest[0], rest[1], rest[1])
                rest = None
        if rest is not None:
            yield from pairs(*rest)

    return tidy(run)


def _groups(batches, n: int, shared, keys: int):
    """Of rows sorted by `keys` leading columns, then name and text as the last two: for each group its rows and ordered sets."""
    (order, named), rows, sets, now = shared.value, [], [], None
    for b in batches:
        own = (s for block in blocks(b.column(b.num_columns - 1)) for s in sets_of(block, n))
        for row, s in zip(zip(*[b.column(k).to_pylist() for k in range(b.num_columns - 1)]), own):
            if row[:keys] != now:
                if rows:
                    yield rows, sets
                rows, sets, now = [], [], row[:keys]
            if len(s) and named.of(s) == row[-1]:  # else another text under the same id
                rows.append(row)
                sets.append(order.sort(s))
    if rows:
        yield rows, sets


def _join_buckets(n: int, percent: int, shared):
    """Rows (bucket, probes, id, name, text): (a, b, linked) for all probes and sets of a bucket whose overlap is within the ring."""

    def run(batches):
        out = []
        for rows, sets in _groups(batches, n, shared, 1):
            asks, asked = ([i for i, r in enumerate(rows) if r[1] & side] for side in (PROBE, MEMBER))
            for k, j, overlap in Trie([sets[i] for i in asked]).join([sets[i] for i in asks], 2 * percent - 100):
                a, b = asks[j], asked[k]
                if a != b:
                    out.append((rows[a][2], rows[b][2], overlap * (100 + percent) >= percent * (len(sets[a]) + len(sets[b]))))
            if len(out) >= 4096:
                yield _links(out)
                out = []
        yield _links(out)

    return tidy(run)


def _links(out: list) -> pa.RecordBatch:
    a, b, linked = zip(*out) if out else ((), (), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def _join_blocks(n: int, percent: int, shared):
    """Rows (gram, x, y, side, id, component, name, text): links between components, in one block."""

    def run(batches):
        out = []
        for rows, sets in _groups(batches, n, shared, 3):
            root = {r[5]: r[5] for r in rows}

            def find(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            left, right = ([i for i, r in enumerate(rows) if r[3] == side] for side in (0, 1))
            if not left or not right:
                left = right = left or right
            for k, j, _ in Trie([sets[i] for i in right]).join([sets[i] for i in left], percent):
                a, b = find(rows[left[j]][5]), find(rows[right[k]][5])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((rows[left[j]][4], rows[right[k]][4], True))
            if len(out) >= 4096:
                yield _links(out)
                out = []
        yield _links(out)

    return tidy(run)


def _spread(rows: DataFrame, docs: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
    """Rows with the text of their id, dealt out and sorted by keys."""
    rows = staged(rows, "jaccard-wanted")
    ids = rows.select(F.col("id").alias("w_id")).distinct()
    if rows.count() <= FEW:  # so few ids can be sent to every task, which then drops the other texts before the shuffle
        docs = docs.join(F.broadcast(ids), F.col("t_id") == F.col("w_id"), "left_semi")
    got = rows.join(docs.select("t_id", "t_text"), F.col("id") == F.col("t_id")).select(*keys, *rest, "digest", "t_text")
    tasks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # groups differ in work, not only in bytes
    return got.repartition(tasks, *keys).sortWithinPartitions(*keys, *rest)


def _checked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int, shared) -> DataFrame:
    """(a, b, linked) of the pairs of nodes whose overlap is within the ring, joined through the tries of their buckets."""
    many = staged(pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).withColumnRenamed("a", "m"), "jaccard-leaders")
    buckets = max(1, -(-pairs.count() // BUCKET))
    dealt = pairs.join(many, F.col("a") == F.col("m")).withColumn("bucket", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), "chunks")), F.lit(buckets)))
    both = dealt.select("bucket", F.col("a").alias("digest"), F.lit(PROBE).alias("side")).union(dealt.select("bucket", F.col("b").alias("digest"), F.lit(MEMBER).alias("side")))
    both = both.groupBy("bucket", "digest").agg(F.bit_or("side").alias("side"))
    both = both.join(nodes.select(F.col("digest").alias("d"), "id"), F.col("digest") == F.col("d"))
    found = _spread(both.select("bucket", "side", "id", "digest"), docs, ["bucket"], ["side", "id"]).mapInArrow(_join_buckets(words, percent, shared), "a long, b long, linked boolean")
    return staged(found, "jaccard-links")


def _led(members: DataFrame) -> DataFrame:
    """(gram, a, b): members (gram, b) of long lists with their list's leader a."""
    often = staged(members.groupBy("b").agg(F.count("*").alias("lists")).withColumnRenamed("b", "o"), "jaccard-members")
    leader = members.join(often, F.col("b") == F.col("o")).groupBy("gram").agg(F.max(F.struct("lists", "b")).alias("most"))
    leader = staged(leader.select(F.col("gram").alias("l_gram"), F.col("most.b").alias("a")), "jaccard-list-leaders")
    return staged(members.join(leader, F.col("gram") == F.col("l_gram")).select("gram", "a", "b"), "jaccard-stars")


def _several(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links through ids that have several texts, from the smallest of their nodes to the others."""
    own = sets.where("n > 0 AND id IS NOT NULL")
    many = own.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select(F.col("id").alias("m"))
    own = own.join(many, F.col("id") == F.col("m")).select("m", F.col("digest").alias("s")).distinct()
    own = staged(own.join(nodes, F.col("s") == F.col("digest")).select("m", F.col("id").alias("b")).distinct(), "jaccard-several-texts")
    least = own.groupBy(F.col("m").alias("l")).agg(F.min("b").alias("a"))
    return own.join(least, F.col("m") == F.col("l")).where("a <> b").select("a", "b").distinct()


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, name_bits: int = NAME_BITS) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of df; ids are integers."""
    spark, start = df.sparkSession, tables()
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("t_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t_text"))
    scan = staged(docs.mapInArrow(_scan(words, name_bits), "kind byte, id long, digest long, other long, x long, y long"), "jaccard-scan")
    kept = tables() - start
    sets = scan.where("kind = 0").select("id", "digest", "other", F.col("x").alias("n"))
    same = sets.where("n > 0").groupBy("digest").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo < hi").select("digest")
    clashes = frozenset(r.digest for r in same.limit(MOST_CLASHES).collect())
    if len(clashes) == MOST_CLASHES:
        raise RuntimeError("more names of sets clash than 64 bits allow for")
    sets = sets.select("id", (F.when(F.col("digest").isin(*clashes), F.col("other")).otherwise(F.col("digest")) if clashes else F.col("digest")).alias("digest"), "n")
    hot = scan.where("kind = 1").groupBy("x").agg(F.sum("y").alias("y")).orderBy(F.col("y").desc(), "x").limit(HOT).toArrow()  # at most HOT rows of two integers
    shared = spark.sparkContext.broadcast((Order(hot.column(0).to_numpy().astype(np.uint64), hot.column(1).to_numpy()), Names(clashes, name_bits)))
    rows = staged(docs.select("t_text").mapInArrow(_prefixes(words, percent, shared), "gram long, digest long, place long"), "jaccard-prefixes")
    # lists of grams known to be frequent: at most HOT rows, which is the bound for broadcasting them
    big = rows.where(F.col("gram") >= F.lit(1 << LEVEL_BITS)).groupBy("gram").agg(F.count("*").alias("size")).where(F.col("size") > SHORT_LIST)
    big = staged(big.select(F.col("gram").alias("big")), "jaccard-long-lists")
    cold = rows.join(F.broadcast(big), F.col("gram") == F.col("big"), "left_anti").repartition("gram").sortWithinPartitions("gram", "digest")
    found = staged(cold.mapInArrow(_candidates(percent), "kind byte, gram long, a long, b long"), "jaccard-candidates", narrow=True)
    star = rows.join(F.broadcast(big), F.col("gram") == F.col("big")).select("gram", F.col("digest").alias("b")).distinct()
    star = _led(staged(star.union(found.where("kind = 1").select("gram", "b")), "jaccard-long-members"))
    nodes = staged(sets.where("n > 0").groupBy("digest").agg(F.min("id").alias("id")).where("id is not null"), "jaccard-nodes")
    twice = found.where("kind = 0").groupBy("a", "b").count().where("count >= 2")
    pairs = staged(twice.select("a", "b").union(star.where("a <> b").select("a", "b")).distinct(), "jaccard-pairs")
    checked = _checked(pairs, nodes, docs, words, percent, shared)
    links = checked.where("linked").select("a", "b")
    several = _several(sets, nodes)
    if not several.isEmpty():
        links = links.union(several)
    parts = components(links)
    open_ = _open_lists(star, nodes, checked, parts)
    for _ in range(PIVOTS):
        rest = open_.where((F.col("n_rest") > FEW_BLOCKS * BLOCK) & F.col("within") & (F.col("place") > 0)).select("gram", F.col("digest").alias("b"))
        if rest.isEmpty():
            break
        apart = staged(_led(rest).where("a <> b").select("a", "b").distinct(), "jaccard-rest-pairs")
        links = links.union(_checked(apart, nodes, docs, words, percent, shared).where("linked").select("a", "b"))
        parts = components(links)
        open_ = _open_lists(star, nodes, checked, parts)
    more = _blocks(open_)
    if not more.isEmpty():
        extra = _spread(more, docs, ["gram", "x", "y"], ["side", "id", "component"]).mapInArrow(_join_blocks(words, percent, shared), "a long, b long, linked boolean")
        extra = staged(extra, "jaccard-more-links")
        if not extra.isEmpty():
            parts = components(links.union(extra.select("a", "b")))
    shared.destroy()
    used = tables() - start - kept
    named = staged(nodes.join(parts.withColumnRenamed("id", "p"), F.col("id") == F.col("p"), "left").select(F.col("digest").alias("d"), F.coalesce("component", "id").alias("component")), "jaccard-classes")
    drop(used)
    out = sets.join(named, F.col("digest") == F.col("d"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _open_lists(star: DataFrame, nodes: DataFrame, checked: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of long lists that may hold links between components: (gram, digest, id, component, place, n_rest, n_near, within, across).

    place: 0 near the leader (linked with it, or it), 1 in its ring (at up to twice the linking distance), 2 far. Near members are all connected. By the
    triangle inequality no far member links with a near one. within: there may be links among ring and far members; across: between near and ring.
    """
    label = F.coalesce("component", "id")
    of = nodes.join(parts.withColumnRenamed("id", "p"), F.col("id") == F.col("p"), "left").select("digest", "id", label.alias("component"))
    own = star.join(of, F.col("b") == F.col("digest")).select("gram", "a", "digest", "id", "component")
    open_ = own.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(F.col("gram").alias("o_gram"))
    own = own.join(open_, F.col("gram") == F.col("o_gram")).join(nodes.select(F.col("digest").alias("f_digest"), F.col("id").alias("f")), F.col("a") == F.col("f_digest"))
    close = checked.groupBy(F.col("a").alias("c_a"), F.col("b").alias("c_b")).agg(F.max("linked").alias("near"))
    own = own.join(close, (F.col("f") == F.col("c_a")) & (F.col("id") == F.col("c_b")), "left")
    own = own.withColumn("place", F.when(F.col("f") == F.col("id"), 0).when(F.col("near"), 0).when(F.col("near").isNotNull(), 1).otherwise(2))
    own = staged(own.select("gram", "digest", "id", "component", "place"), "jaccard-open")
    span = lambda kept, name: [F.min(F.when(kept, F.col("component"))).alias(f"{name}_lo"), F.max(F.when(kept, F.col("component"))).alias(f"{name}_hi")]
    lists = own.groupBy(F.col("gram").alias("s_gram")).agg(*span(F.col("place") > 0, "rest"), *span(F.col("place") < 2, "close"), F.max((F.col("place") == 1).cast("int")).alias("ring"), F.count_if(F.col("place") > 0).alias("n_rest"), F.count_if(F.col("place") == 0).alias("n_near"))
    differ = lambda name: F.coalesce(F.col(f"{name}_lo") < F.col(f"{name}_hi"), F.lit(False))
    lists = lists.select("s_gram", "n_rest", "n_near", differ("rest").alias("within"), (differ("close") & (F.col("ring") == 1)).alias("across")).where("within OR across")
    return staged(own.join(lists, F.col("gram") == F.col("s_gram")).drop("s_gram"), "jaccard-open-lists")


def _blocks(open_: DataFrame) -> DataFrame:
    """What is left to compare: (gram, x, y, side, id, component, digest), BLOCK members a side."""
    own = open_.withColumns({n: F.ceil(F.col(n) / BLOCK) for n in ("n_near", "n_rest")})
    to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    rest, near, ring = F.col("within") & (F.col("place") > 0), F.col("across") & (F.col("place") == 0), F.col("across") & (F.col("place") == 1)
    mine = F.pmod(F.xxhash64("digest"), F.col("n_rest"))
    beside = F.pmod(F.xxhash64("digest"), F.col("n_near"))
    cols = ["gram", "x", "y", "side", "id", "component", "digest"]
    within = own.where(rest).withColumn("me", mine).withColumn("o", F.explode(to(F.col("n_rest")))).select("*", F.least("me", "o").alias("x"), F.greatest("me", "o").alias("y"), F.when(F.col("me") <= F.col("o"), 0).otherwise(1).alias("side")).select(*cols)
    over = own.where(ring).withColumn("x", mine).withColumn("o", F.explode(to(F.col("n_near")))).withColumn("y", -1 - F.col("o")).withColumn("side", F.lit(0)).select(*cols)
    under = own.where(near).withColumn("y", -1 - beside).withColumn("x", F.explode(to(F.col("n_rest")))).withColumn("side", F.lit(1)).select(*cols)
    return staged(within.union(over).union(under), "jaccard-blocks")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """df's rows with one of each group: that of the smallest id, null ids last. Rows with an empty set all stay; of rows alike in all columns one stays.

    Rows, not ids, are grouped: they are named by 64 bits of id and text, so that null ids are compared too and two texts of one id are judged apart.
    """
    row, named, nth = free(df.columns, "w_row", "w_named", "w_nth")
    keyed = df.withColumn(row, F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    names = keyed.groupBy(F.col(row).alias("r"), F.col(f"`{id_col}`").alias("i")).agg(F.count("*").alias("copies"))
    groups = similar(keyed, row, text_col, words, percent).where("n_shingles > 0").select(F.col(row).alias("g"), F.col("component_id").alias("c")).distinct()
    rows = staged(groups.join(names, F.col("g") == F.col("r")).select("r", "c", F.struct(F.col("i").isNull(), "i", "r").alias("place"), "copies"), "jaccard-rows")
    first = rows.groupBy(F.col("c").alias("f_c")).agg(F.min("place").alias("first"))
    judged = staged(rows.join(first, F.col("c") == F.col("f_c")).select(F.col("r").alias(named), (F.col("place") == F.col("first")).alias("stays"), "copies"), "jaccard-judged")
    same = F.col(row) == F.col(named)
    kept = keyed.join(judged.where("NOT stays").select(named), same, "left_anti")
    repeated = judged.where("stays AND copies > 1").select(named)
    if not repeated.isEmpty():
        order = Window.partitionBy(row).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
        one = kept.join(repeated, same, "left_semi").withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
        kept = kept.join(repeated, same, "left_anti").unionByName(one)
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
