"""Operator 11: remove what repeats, byte by byte, by the common-prefix interval tree of an enhanced suffix array.

A window is WINDOW consecutive bytes of one document. Of a window the GRAM-byte slice with the smallest hash is its mark; equal windows have equal
marks at equal places, and neighbouring windows mostly share one. The windows that share one mark are a stretch (under 2 * WINDOW bytes). The steps:

1. Marks are counted over all documents. Those that occur once can't be in a repeat; a bit map of the others goes to the next pass.
2. Stretches under a recurring mark are gathered by mark and content. All but the first of those that are alike are copies: each of their windows starts
   earlier elsewhere. The first ones are a dictionary of different stretches, as in prefix-free parsing of a repetitive text.
3. Stretches that share their mark with a different one are dealt to shards by mark. A shard sorts the suffixes that begin at their windows, takes the common prefix of
   neighbours in that suffix array, and scans it once with a stack. The stack closes the intervals of the common-prefix tree; an interval whose suffixes have more
   than one left neighbour can't be extended to the left: it is a maximal repeat, and all its suffixes are its occurrences. An interval with one left neighbour is part of a longer repeat and says nothing new.
4. Of each maximal repeat all occurrences but the first lose their bytes.

That is the same as judging each window: a window with an earlier copy lies in a maximal repeat, in which its occurrence isn't the first either. Repeats are maximal within
their stretches: one that is longer than a stretch comes as several that overlap, which cover the same bytes.

Scale: the marks of a text are some 6 % of its bytes in number. A mark with over MANY different stretches is not left to one task: its windows are matched one by one,
by 128 bits of hash, with partial aggregates. Contents alike are told by their mark's and their own 64-bit hashes; suffixes are compared byte by byte. The bit maps have a bounded size;
once they fill up, more stretches pass than need to, at most all of them, and no result changes.

Cases: null text: no bytes. Texts under WINDOW bytes lose nothing, but their rows stay. Order is by doc_id, then by start; different rows of one doc_id
are documents of their own in the order of a hash of their text, and equal rows of one doc_id are one document, which all get its result. Null ids neither lose bytes nor
count. Extra columns don't matter, whatever their names. Long texts are taken in segments with overlap, never cut. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velora.llm.bitmaps import bit_map
from velora.llm.staging import drop, staged, tables
from velora.llm.words import _strings, gram_starts, tidy

WINDOW, GRAM = 100, 32
#: Bytes of text that are handled at a time; with a window they stay below 2**PLACE.
SEGMENT, PLACE = 1 << 17, 18
#: Suffixes that a shard sorts at a time, and different stretches of one mark that are left to one shard.
SUFFIXES, MANY = 1 << 16, 1 << 10
_FACTORS = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


@dataclass
class Piece:
    """Some whole texts, or a segment of one, as bytes."""

    at: np.ndarray  # places of the texts in their batch
    data: np.ndarray
    bounds: np.ndarray  # len(at) + 1 offsets
    base: int  # of the first byte in its text


def pieces(column: pa.Array, window: int) -> Iterator[Piece]:
    """A text over SEGMENT bytes comes in segments that begin at multiples of SEGMENT, so that equal texts are parted alike; each window is in one of them."""
    data, offsets = _strings(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= SEGMENT:
            yield Piece(np.arange(i, j), data[lo:hi], offsets[i : j + 1] - lo, 0)
        else:
            for at in range(lo, hi - window + 1, SEGMENT):
                end = min(hi, at + SEGMENT + window - 1)
                yield Piece(np.array([i]), data[at:end], np.array([0, end - at]), at - lo)
        i = j


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _FACTORS[0]
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Of the gram bytes from each place on, eight at a time."""
    n, data = len(data) - gram + 1, np.ascontiguousarray(data)
    h = np.full(n, gram, np.uint64)
    for k, at in enumerate([*range(0, gram - 8, 8), gram - 8]):
        word = np.ndarray((n,), "<u8", data, at, (1,)) ^ _FACTORS[k % 4]
        word *= _FACTORS[(k + 1) % 4]
        h += word ^ (word >> np.uint64(32))
        h *= _FACTORS[(k + 2) % 4]
    return _mixed(h)


@dataclass
class Stretches:
    """Runs of windows with one mark."""

    owner: np.ndarray  # place of the text in its piece
    start: np.ndarray  # of the first window, in the piece
    n: np.ndarray  # windows
    mark: np.ndarray  # hash of the mark
    whole: np.ndarray  # hash of all bytes


def stretches(piece: Piece, window: int, gram: int) -> Stretches | None:
    start, counts = gram_starts(piece.bounds, window)
    if not len(start):
        return None
    h = gram_hashes(piece.data, gram)
    best = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)  # the first of equal ones is smallest
    span, reach = window - gram + 1, 1
    while reach < span:  # sliding minimum by doubling
        step = min(reach, span - reach)
        best, reach = np.minimum(best[: len(best) - step], best[step:]), reach + step
    mark = (best[start] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (start[1:] != start[:-1] + 1)
    lo = np.flatnonzero(new)
    n = np.diff(np.append(lo, len(start)))
    owner = np.repeat(np.arange(len(piece.at)), counts)[lo]
    first, mark = start[lo], mark[lo]
    last = first + n - 1 + window - gram  # where the last gram begins
    whole = n.astype(np.uint64)
    for at in range(0, 2 * window - gram, gram):
        whole = whole * _FACTORS[1] + h[np.minimum(first + at, last)]
        whole = _mixed(whole)
    return Stretches(owner, first, n, h[mark].view(np.int64), whole.view(np.int64))


def maximal_repeats(lcp: list[int], left: list[int], rank: list[int], least: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """(length, first suffix, last suffix, parts) of each interval of a suffix array with a common prefix of least or more and more than one left neighbour.

    lcp[i] is the common prefix of suffixes i and i + 1; left[i] the byte before suffix i, below 0 where there is none. An interval's parts are its own suffixes and, of each
    interval inside it, the suffix of the smallest rank. One stack scan closes each interval after all that are inside it.
    """
    open_: list[list] = []  # length, first suffix, left neighbour (below 0: several), parts
    for i in range(len(left)):
        lo, byte, part = i, left[i], i
        up = lcp[i] if i < len(lcp) else 0
        while open_ and open_[-1][0] > up:
            length, lo, mine, parts = open_.pop()
            parts.append(part)
            byte = mine if mine == byte else -1
            if byte < 0:
                yield length, lo, i, parts
            part = min(parts, key=rank.__getitem__)
        if up >= least:
            if open_ and open_[-1][0] == up:
                top = open_[-1]
                top[2] = top[2] if top[2] == byte else -1
                top[3].append(part)
            else:
                open_.append([up, lo, byte, [part]])


class Shard:
    """Different stretches: their suffixes, one for each window, in order, and the intervals of their common prefixes."""

    def __init__(self, texts: list[bytes], order: list[np.ndarray], window: int):
        """order: keys of each stretch, the last one its start; a suffix's position adds its offset to that."""
        size = np.array([len(t) for t in texts])
        longest = int(size.max())
        flat, before = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size
        padded = np.zeros((len(texts), 2 * longest), np.uint8)
        padded[np.repeat(np.arange(len(texts)), size), np.arange(len(flat)) - np.repeat(before, size)] = flat
        n = size - window + 1
        of = np.repeat(np.arange(len(texts)), n)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        suffix = np.lib.stride_tricks.sliding_window_view(padded, longest, axis=1)[of, offset]
        by = np.argsort(suffix.view(f"V{longest}").ravel())
        self.of, self.offset, suffix = of[by], offset[by], suffix[by]
        length = size[self.of] - self.offset
        apart = suffix[1:] != suffix[:-1]
        first = np.where(apart.any(1), apart.argmax(1), longest) if len(by) > 1 else np.empty(0, np.int64)
        self.lcp = np.minimum(np.minimum(first, length[1:]), length[:-1])
        self.left = np.where(self.offset > 0, padded[self.of, np.maximum(self.offset - 1, 0)].astype(np.int64), -1 - np.arange(len(by)))
        rank = np.lexsort([*(k[self.of] for k in order[:-1]), order[-1][self.of] + self.offset][::-1])
        self.rank = np.empty(len(by), np.int64)
        self.rank[rank] = np.arange(len(by))
        self.window = window

    def repeats(self) -> Iterator[tuple[int, int, int, list[int]]]:
        """maximal_repeats of each run of suffixes that share a window; runs with one left neighbour in all hold none and are skipped."""
        alike = np.concatenate(([0], (self.lcp >= self.window).view(np.int8), [0]))
        begin, end = np.flatnonzero(np.diff(alike) == 1), np.flatnonzero(np.diff(alike) == -1)
        for lo, hi in zip(begin.tolist(), end.tolist()):
            left = self.left[lo : hi + 1]
            if left[0] >= 0 and (left == left[0]).all():
                continue
            for length, a, b, parts in maximal_repeats(self.lcp[lo:hi].tolist(), left.tolist(), self.rank[lo : hi + 1].tolist(), self.window):
                yield length, lo + a, lo + b, [lo + p for p in parts]


def _marks(window: int, gram: int):
    """(mark, n) once for each batch."""

    def run(batches):
        for b in batches:
            found = [s.mark for p in pieces(b.column(0), window) if (s := stretches(p, window, gram)) is not None]
            if found:
                mark, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([pa.array(mark), pa.array(n)], names=["mark", "n"])

    return tidy(run)


def _recurring(batch: pa.RecordBatch, window: int, gram: int, often) -> tuple[np.ndarray, ...]:
    """(row in the batch, start in its text, n, mark, whole) of the stretches of a batch (id, th, text, ...) whose mark may recur."""
    found = [[np.empty(0, np.int64)] * 5]
    for p in pieces(batch.column(2), window):
        if (s := stretches(p, window, gram)) is None:
            continue
        own = np.flatnonzero(often.has(s.mark))
        found.append([p.at[s.owner[own]], s.start[own] - p.bounds[s.owner[own]] + p.base, s.n[own], s.mark[own], s.whole[own]])
    return tuple(np.concatenate(x) for x in zip(*found))


def _rows(window: int, gram: int, shared, every: bool):
    """(mark, whole, id, th, at, n): of stretches that are alike in a batch only the first, as the others can't be first of all; or every one."""

    def run(batches):
        for b in batches:
            row, at, n, mark, whole = _recurring(b, window, gram, shared.value)
            ids, th = b.column(0).to_numpy()[row], b.column(1).to_numpy()[row]
            if every:
                keep = np.arange(len(row))
            else:
                by = np.lexsort((at, th, ids, whole, mark))
                new = np.ones(len(by), bool)
                new[1:] = (mark[by][1:] != mark[by][:-1]) | (whole[by][1:] != whole[by][:-1])
                keep = by[new]
            yield pa.record_batch([pa.array(x[keep]) for x in (mark, whole, ids, th, at)] + [pa.array(n[keep].astype(np.int32))], names=["mark", "whole", "id", "th", "at", "n"])

    return tidy(run)


def _bytes(window: int, gram: int, shared, open_, hot):
    """Of documents (id, th, text, firsts): the bytes of their first stretches under open marks; under hot ones a row for each window, with hashes only."""

    def run(batches):
        for b in batches:
            row, at, n, mark, whole = _recurring(b, window, gram, shared.value)
            own = open_.value.has(mark) & _listed(b.column(3), row, at)
            row, at, n, mark, whole = (x[own] for x in (row, at, n, mark, whole))
            ids, th, many = b.column(0).to_numpy()[row], b.column(1).to_numpy()[row], hot.value.has(mark)
            data, offsets = _strings(b.column(2))
            lo, hi = offsets[row] + at, offsets[row] + at + n + window - 1
            few = np.flatnonzero(~many)
            if len(few):
                texts = pa.array([data[x:y].tobytes() for x, y in zip(lo[few].tolist(), hi[few].tolist())], pa.binary())
                none = pa.nulls(len(few), pa.int64())
                yield pa.record_batch([pa.array(mark[few]), pa.array(whole[few]), pa.array(ids[few]), pa.array(th[few]), pa.array(at[few]), texts, none], names=["mark", "whole", "id", "th", "at", "bytes", "second"])
            for k in np.flatnonzero(many).tolist():
                part = data[lo[k] : hi[k]]
                a, c = gram_hashes(part, window).view(np.int64), gram_hashes(part ^ np.uint8(0x5A), window).view(np.int64)
                m = len(a)
                yield pa.record_batch([pa.array(a), pa.array(np.full(m, whole[k])), pa.array(np.full(m, ids[k])), pa.array(np.full(m, th[k])), pa.array(at[k] + np.arange(m)), pa.nulls(m, pa.binary()), pa.array(c)], names=["mark", "whole", "id", "th", "at", "bytes", "second"])

    return tidy(run)


def _listed(lists: pa.Array, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether (row, at) is in the row's list; a null list is empty."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = np.diff(lists.offsets.to_numpy()) * ~lists.is_null().to_numpy(zero_copy_only=False)
    key = lambda r, a: (r.astype(np.int64) << 40) | a  # noqa: E731  a batch has few rows, a text under 2**31 bytes
    return np.isin(key(row, at), key(np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))


def _shards(window: int, groups: bool):
    """Stretches (mark, whole, id, th, at, bytes) in order of mark: (id, th, at, n) of what a maximal repeat takes away; or (repeat, n, mark, whole, offset) of all occurrences."""

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        mark, whole, ids, th, at, texts = zip(*rows)
        keys = [np.array(x) for x in (ids, th, at)]
        shard = Shard(texts, keys, window)
        if groups:
            out = []
            for length, lo, hi, _ in shard.repeats():
                o, of = int(shard.offset[lo]), int(shard.of[lo])
                name = int.from_bytes(hashlib.blake2b(texts[of][o : o + length], digest_size=8).digest(), "little", signed=True)
                out += [(name, length, mark[s], whole[s], k) for s, k in zip(shard.of[lo : hi + 1].tolist(), shard.offset[lo : hi + 1].tolist())]
            return pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*out) if out else [()] * 5)], names=["repeat", "length", "mark", "whole", "offset"])
        lost, size = [], []
        for length, _, _, parts in shard.repeats():
            first = min(parts, key=shard.rank.__getitem__)
            rest = [p for p in parts if p != first]
            lost += rest
            size += [length] * len(rest)
        of = shard.of[lost] if lost else np.empty(0, np.int64)
        offset = shard.offset[lost] if lost else of
        return pa.record_batch([pa.array(keys[0][of]), pa.array(keys[1][of]), pa.array(keys[2][of] + offset), pa.array(size, pa.int64())], names=["id", "th", "at", "n"])

    def run(batches):
        held, size, now = [], 0, None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns[:6])):
                if r[0] != now and size >= SUFFIXES:
                    yield judged(held)
                    held, size = [], 0
                now = r[0]
                held.append(r)
                size += len(r[5]) - window + 1
        if held:
            yield judged(held)

    return tidy(run)


def _kept(window: int, gram: int, shared):
    """Documents (id, th, text, firsts, lost) to (id, n_bytes, spans, kept)."""

    def run(batches):
        for b in batches:
            row, at, n, mark, whole = _recurring(b, window, gram, shared.value)
            copy = ~_listed(b.column(3), row, at) & b.column(0).is_valid().to_numpy(zero_copy_only=False)[row]
            row, lo, hi = row[copy], at[copy], (at + n + window - 1)[copy]
            lists = b.column(4)
            size = np.diff(lists.offsets.to_numpy()) * ~lists.is_null().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            more = flat.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.concatenate([row, np.repeat(np.arange(len(size)), size)])
            lo, hi = np.concatenate([lo, more]), np.concatenate([hi, more + flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)])
            by = np.lexsort((lo, row))
            row, lo, hi = row[by], lo[by], hi[by]
            first = np.searchsorted(row, np.arange(len(size) + 1))
            data, offsets = _strings(b.column(2))
            spans, kept = [], []
            for i in range(len(size)):
                text, own, end = data[offsets[i] : offsets[i + 1]], [], 0
                parts = []
                for x, y in zip(lo[first[i] : first[i + 1]].tolist(), hi[first[i] : first[i + 1]].tolist()):
                    if own and x <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], y)
                    else:
                        own.append({"start": x, "end": y})
                for s in own:
                    parts.append(text[end : s["start"]])
                    end = s["end"]
                kept.append(b"".join([*parts, text[end:]]))
                spans.append(own)
            yield pa.record_batch(
                [b.column(0), pa.array(np.diff(offsets)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "spans", "kept"],
            )

    return tidy(run)


_ROW = "mark long, whole long, id long, th long, at long, n int"


class Found:
    """The dictionary of different stretches of a table, and what its maximal repeats take away."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, window: int, gram: int):
        self.window, self.gram, self.spark = window, gram, df.sparkSession
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        self.docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
        self.usable = self.docs.where(F.col("id").isNotNull() & (F.octet_length("text") >= window))
        marks = self.usable.select("text").mapInArrow(_marks(window, gram), "mark long, n long")
        often = staged(marks.groupBy("mark").agg(F.sum("n").alias("n")).where("n > 1").select("mark"), "suffix-often", narrow=False)
        self.often = self._share(bit_map(often, "mark"))
        rows = self.usable.mapInArrow(_rows(window, gram, self.often, every=False), _ROW)
        first = rows.groupBy("mark", "whole").agg(F.min(F.struct("id", "th", "at", "n")).alias("first"))
        self.wholes = staged(first.select("mark", "whole", "first.*"), "suffix-wholes")
        kinds = staged(self.wholes.groupBy("mark").agg(F.count("*").alias("kinds")).where("kinds > 1"), "suffix-kinds")
        self.open, self.hot = self._share(bit_map(kinds, "mark")), self._share(bit_map(kinds.where(F.col("kinds") > MANY), "mark"))
        lists = self.wholes.groupBy("id", "th").agg(F.collect_list("at").alias("firsts"))
        self.firsts = staged(lists.toDF("f_id", "f_th", "firsts"), "suffix-firsts")

    def _share(self, value):
        return self.spark.sparkContext.broadcast(value)

    def with_firsts(self, docs: DataFrame, how: str = "left") -> DataFrame:
        return docs.join(self.firsts, (F.col("id") == F.col("f_id")) & (F.col("th") == F.col("f_th")), how).select("id", "th", "text", "firsts")

    def dealt(self) -> DataFrame:
        kind = "mark long, whole long, id long, th long, at long, bytes binary, second long"
        return self.with_firsts(self.usable, "inner").mapInArrow(_bytes(self.window, self.gram, self.often, self.open, self.hot), kind)

    def lost(self) -> DataFrame:
        """(id, th, at, n) of what isn't first in a maximal repeat."""
        dealt = staged(self.dealt(), "suffix-dealt")
        trees = dealt.where("bytes is not null").drop("second").repartition("mark").sortWithinPartitions("mark").mapInArrow(_shards(self.window, groups=False), "id long, th long, at long, n long")
        single = dealt.where("bytes is null").select("mark", "second", F.struct("id", "th", "at").alias("place"))
        least = single.groupBy("mark", "second").agg(F.min("place").alias("least"), F.max("place").alias("most")).where("least < most").select(F.col("mark").alias("l_mark"), F.col("second").alias("l_second"), "least")
        single = single.join(least, (F.col("mark") == F.col("l_mark")) & (F.col("second") == F.col("l_second"))).where("least < place").select("place.*", F.lit(self.window).cast("long").alias("n"))
        return trees.union(single)


def dedup_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id_col, n_bytes, spans, kept): spans are the maximal runs of removed bytes, kept the bytes that stay. window must be at least gram, gram at least 8."""
    before = tables()
    found = Found(df, id_col, text_col, window, gram)
    lost = found.lost().groupBy("id", "th").agg(F.collect_list(F.struct("at", "n")).alias("lost")).toDF("l_id", "l_th", "lost")
    lists = found.firsts.join(lost, (F.col("f_id") == F.col("l_id")) & (F.col("f_th") == F.col("l_th")), "left").select("f_id", "f_th", "firsts", "lost")  # what loses has stretches of its own
    used = tables() - before
    lists = staged(lists, "suffix-lists")
    drop(used)
    rows = found.docs.join(lists, (F.col("id") == F.col("f_id")) & (F.col("th") == F.col("f_th")), "left").select("id", "th", "text", "firsts", "lost")
    out = rows.mapInArrow(_kept(window, gram, found.often), "id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def repeat_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(repeat, length, id_col, start): every occurrence of every maximal repeat, copies included. repeat names its bytes; repeats longer than a stretch come in parts that overlap.

    Stretches that are alike are a repeat of their own, and occurrences found in a stretch are those of all its copies. Under a hot mark the repeats are its windows. Rows of one id that
    are alike count once."""
    found = Found(df, id_col, text_col, window, gram)
    docs = found.usable.dropDuplicates(["id", "th"])
    every = staged(docs.mapInArrow(_rows(window, gram, found.often, every=True), _ROW), "suffix-every")
    dealt = staged(found.dealt(), "suffix-dealt")
    kind = "repeat long, length long, mark long, whole long, offset long"
    trees = dealt.where("bytes is not null").drop("second").repartition("mark").sortWithinPartitions("mark").mapInArrow(_shards(window, groups=True), kind)
    trees = staged(trees.toDF("repeat", "length", "t_mark", "t_whole", "offset"), "suffix-trees")
    inner = every.join(trees, (F.col("mark") == F.col("t_mark")) & (F.col("whole") == F.col("t_whole"))).select("repeat", "length", "id", (F.col("at") + F.col("offset")).alias("start"))
    # under hot marks: windows, with all copies of the stretches that hold them
    alone = dealt.where("bytes is null").select(F.col("mark").alias("w_mark"), F.col("second").alias("w_second"), F.col("whole").alias("s_whole"), F.col("id").alias("s_id"), F.col("at").alias("s_at"))
    firsts = found.wholes.toDF("o_mark", "o_whole", "o_id", "o_th", "o_at", "o_n")
    alone = alone.join(firsts, (F.col("s_whole") == F.col("o_whole")) & (F.col("s_id") == F.col("o_id")) & F.col("s_at").between(F.col("o_at"), F.col("o_at") + F.col("o_n") - 1))
    alone = staged(alone.select("o_mark", "o_whole", "w_mark", "w_second", (F.col("s_at") - F.col("o_at")).alias("o_offset")), "suffix-alone")
    single = every.join(alone, (F.col("mark") == F.col("o_mark")) & (F.col("whole") == F.col("o_whole"))).select("w_mark", "w_second", "id", (F.col("at") + F.col("o_offset")).alias("start"))
    shared = single.groupBy("w_mark", "w_second").count().where("count > 1").toDF("m_mark", "m_second", "m_count")
    single = single.join(shared, (F.col("w_mark") == F.col("m_mark")) & (F.col("w_second") == F.col("m_second"))).select(F.xxhash64("w_mark", "w_second").alias("repeat"), F.lit(window).cast("long").alias("length"), "id", "start")
    # stretches with copies, but for those that an interval or windows stand for
    copies = every.groupBy("mark", "whole", "n").count().where("count > 1").select(F.col("mark").alias("c_mark"), F.col("whole").alias("c_whole"), (F.col("n") + window - 1).cast("long").alias("length"))
    copies = copies.join(trees.where("offset = 0").select("t_mark", "t_whole", F.col("length").alias("t_length")), (F.col("c_mark") == F.col("t_mark")) & (F.col("c_whole") == F.col("t_whole")) & (F.col("length") == F.col("t_length")), "left_anti")
    copies = copies.join(alone, (F.col("c_mark") == F.col("o_mark")) & (F.col("c_whole") == F.col("o_whole")), "left_anti")
    copies = every.join(copies, (F.col("mark") == F.col("c_mark")) & (F.col("whole") == F.col("c_whole"))).select(F.xxhash64("mark", "whole").alias("repeat"), "length", "id", F.col("at").alias("start"))
    out = inner.union(copies).union(single).distinct()
    return out.withColumnRenamed("id", id_col)
