"""Operator 13: phrase collocations. Candidates come from a sketch's upper bounds and are counted exactly by Aho-Corasick automata.

A phrase is 2 to WORDS consecutive words of one piece of a text. The steps:

1. Every phrase of every text is hashed with its language to a cell in each of the ROWS rows of a count-min sketch, with one counter in a row for about each CELL_BYTES bytes of the
   corpus. A cell counts all phrases that fall into it, so it bounds each one's count from above. Tasks add up their own phrases first; counters go by slices, sparse, each to one task.
2. A phrase with a cell under the threshold can't be frequent, nor can one that holds such a phrase. Bit maps of the other cells go to a second pass. It takes at each word of a text the longest
   phrase that begins there and that, like all phrases in it, the maps let through: a stretch. Every occurrence of a frequent phrase begins a stretch, so a task sends a stretch once, with the number of
   times it came, and no text. Stretches are dealt to buckets by their first two words.
3. A bucket's candidates are the phrases that begin its stretches. About SHARD of them at most are compiled into an automaton. Its words are spelled in DIGITS symbols, of which the first, second and
   third are from alphabets of their own, so that no match begins or ends inside a word. A delimiter, which no phrase holds, guards the ends of pieces and stands for words that the shard doesn't know and
   those that stand in none of its pairs of neighbours. It scans the bucket's stretches, and a match at a stretch's beginning counts as often as the stretch came (matches further on begin stretches of
   their own); sums over buckets are exact counts, and only then thresholds apply. (An automaton over whole words, or letters, finds the same matches: a node with very many children is slow,
   and letters make longer texts.)
4. Cuts, scores, and phrases inside longer ones are joins on the table of counts.

Scale: two passes over the texts besides one for their size, whatever their number and that of the candidates. The sketch grows with the corpus, so that a cell's other phrases stay few; what is held at once does not: a chunk of
hashes, a slice of counters, MAPS maps of 16 MB for each row, CHUNK >> 2 stretches of a task, a shard. With over MAPS * MAP_CELLS cells the maps get fuller and let more through, at most a stretch a word.
A task sends a counter for each different phrase of a chunk, not for each occurrence. Words and phrases are told apart by 64-bit hashes of their bytes and language.

Cases: null and empty texts have no words; a null language is NO_LANG. Repeated rows and null ids count as any others: only text and language matter. Ties: score, then a, falling, then the phrase by
bytes. Extra columns don't matter. Long texts are handled whole. Empty table: empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velora.llm.bitmaps import bit_map
from velora.llm.staging import staged
from velora.llm.substring_dedup import MOST_BITS
from velora.llm.words import LOWER, Block, blocks, give_back, gram_hashes, mixed, tidy

LEAST, WORDS, TOP, SHARE = 30, 4, 2000, 80
SCALE = 2_000_000
NO_LANG = "und"
CELL_BYTES = 4
#: Hashes that a task adds up at a time, and slices and the least and most counters of one, in bits.
CHUNK, SLICES, NARROW, WIDE = 1 << 21, 8, 16, 22
#: Phrases of a shard, cells of one map, bits for each of them if there is room, and the most maps of a row.
SHARD, MAP_CELLS, MAP_BITS, MAPS = 1 << 18, MOST_BITS >> 3, 1 << 10, 4
ROWS, DIGITS = 2, 3
#: Lists of stretches that a task sends, and bytes of stretches that it holds.
BUCKETS, HELD_BYTES = 512, 1 << 26
#: Parts of a language's phrases, each of which sends its first on to the language's own ranks.
PARTS = 32

IS_STOP = np.zeros(256, bool)
IS_STOP[list(b".,;:!?\n\x0b\x0c\r")] = True
IS_GAP = IS_STOP.copy()
IS_GAP[[0x20, 0x09]] = True
_STOP, _FIRST = 10, 256  # the delimiter, and the first symbol
_ODD = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(1 << 16)
def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Words:
    """The words of a block: their keys (hash and language), and how many phrases of each length begin at each word."""

    def __init__(self, block: Block, salts: np.ndarray):
        """salts: of each text of the block."""
        owner = block.text_of_word()
        self.block, self.owner = block, owner
        self.keys = mixed(block.word_hashes(lower=True) + salts[owner] * _ODD) if len(owner) else np.empty(0, np.uint64)
        self.salts = salts[owner]
        stops = np.concatenate(([0], np.cumsum(IS_STOP[block.data], dtype=np.int64)))[block.starts]
        self.begins = np.ones(len(owner), bool)  # a piece
        self.begins[1:] = (stops[1:] != stops[:-1]) | (owner[1:] != owner[:-1])

    def phrases(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(first word, hash, length) of all words, and of all phrases of 2 to most words."""
        piece = np.cumsum(self.begins)
        for n in range(1, most + 1):
            if len(piece) < n:
                return
            start = np.flatnonzero(piece[n - 1 :] == piece[: len(piece) - n + 1])
            yield start, gram_hashes(self.keys, start, n), n

    def stretches(self, most: int, passes: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: how many words the longest phrase has that begins there and passes with all phrases in it (0: none), its hash, and the hash of its first two words."""
        piece, total = np.cumsum(self.begins), len(self.keys)
        size, names, lead = np.zeros(total, np.int64), np.zeros(total, np.uint64), np.zeros(total, np.uint64)
        whole = np.ones(total + 1, bool)  # whether the phrase of n - 1 words passes
        for n in range(1, min(most, total) + 1):
            end = total - n + 1
            start = np.flatnonzero(whole[:end] & whole[1 : end + 1] & (piece[n - 1 :] == piece[:end]))
            h = gram_hashes(self.keys, start, n)
            keep = passes(h)
            start, h = start[keep], h[keep]
            size[start], names[start] = n, h
            if n <= 2:
                lead[start] = h
            whole = np.zeros(total + 1, bool)
            whole[start] = True
        return size, names, lead

    def spelled(self, at: np.ndarray, size: np.ndarray) -> pa.Array:
        """Phrases of size words from each place on, lower-cased, with one space between words."""
        after = np.cumsum(size)
        word = np.repeat(at - (after - size), size) + np.arange(int(size.sum()))
        space = np.ones(len(word), np.int64)
        space[after - 1] = 0
        start, length = self.block.starts[word], self.block.ends[word] - self.block.starts[word] + space
        end = np.cumsum(length)
        data = LOWER[self.block.data[np.minimum(np.repeat(start - (end - length), length) + np.arange(int(length.sum())), len(self.block.data) - 1)]]
        data[end[space > 0] - 1] = 0x20
        offsets = np.concatenate(([0], end[after - 1])).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))


def _texts(batch: pa.RecordBatch) -> Iterator[Words]:
    """The words of a batch (lang, text), block by block."""
    langs = batch.column(0).to_pylist()
    salts = np.array([_salt(lang) for lang in langs], np.uint64)
    for block in blocks(batch.column(1), gap=IS_GAP):
        yield Words(block, salts[block.at])


def slice_bits(cells: int) -> int:
    """Of a slice of a row of 2**cells counters: 2**SLICES slices, whatever the size, as long as a slice is no wider than 2**WIDE."""
    return min(max(cells - SLICES, NARROW), WIDE)


def _count_type(least: int) -> type:
    return np.uint8 if least < 256 else np.uint32


def packed(place: np.ndarray, n: np.ndarray, least: int) -> tuple[bytes, bytes]:
    """Rising places as 16-bit gaps, and their counts; a gap too wide comes as several, with counts of 0."""
    gap = np.diff(place, prepend=0)
    steps = gap // 0xFFFF
    if steps.any():
        last = np.cumsum(steps + 1) - 1
        wide, counts = np.full(last[-1] + 1, 0xFFFF), np.zeros(last[-1] + 1, np.int64)
        wide[last], counts[last] = gap % 0xFFFF, n
        gap, n = wide, counts
    return gap.astype(np.uint16).tobytes(), n.astype(_count_type(least)).tobytes()


def unpacked(gaps: bytes, counts: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    place, n = np.cumsum(np.frombuffer(gaps, np.uint16), dtype=np.int64), np.frombuffer(counts, _count_type(least))
    return place[n > 0], n[n > 0]


def _cells(h: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """The cell of each hash in each row; a row's cells come after those of the rows before."""
    low = np.uint64((1 << cells) - 1)
    for row in range(ROWS):
        yield (h & low) + np.uint64(row << cells)
        h = mixed(h ^ _ODD)


def _sketch(cells: int, least: int, most: int):
    """(slice, gaps, counts) of a sketch with rows of 2**cells counters, sparse, once for each CHUNK of phrases; a count over least is least."""
    wide = slice_bits(cells)

    def summed(held: list[np.ndarray]):
        for names in _cells(np.concatenate(held), cells):
            cell, n = np.unique(names, return_counts=True)
            n, part = np.minimum(n, least), (cell >> np.uint64(wide)).astype(np.int64)
            place = (cell & np.uint64((1 << wide) - 1)).astype(np.int64)
            lo = np.flatnonzero(np.diff(part, prepend=-1))
            hi = np.append(lo[1:], len(part))
            for a in range(0, len(lo), 4096):
                gaps, counts = zip(*(packed(place[x:y], n[x:y], least) for x, y in zip(lo[a : a + 4096].tolist(), hi[a : a + 4096].tolist())))
                yield pa.record_batch([pa.array(part[lo[a : a + 4096]]), pa.array(gaps, pa.binary()), pa.array(counts, pa.binary())], names=["slice", "gaps", "counts"])

    def run(batches):
        _forget()
        held, size = [], 0
        for b in batches:
            for words in _texts(b):
                for _, h, _ in words.phrases(most):
                    held.append(h)
                    size += len(h)
                if size >= CHUNK:
                    yield from summed(held)
                    held, size = [], 0
        if size:
            yield from summed(held)

    return tidy(run)


def _frequent(cells: int, least: int):
    """The cells of at least least, from rows in order of slice."""
    wide = slice_bits(cells)

    def run(batches):
        now, sums = None, None
        out = lambda: pa.record_batch([pa.array((now << wide) + np.flatnonzero(sums >= least))], names=["cell"])
        for b in batches:
            for part, gaps, counts in zip(*(c.to_pylist() for c in b.columns)):
                if part != now:
                    if now is not None:
                        yield out()
                    now, sums = part, np.zeros(1 << wide, np.int64)
                place, n = unpacked(gaps, counts, least)
                sums[place] += n  # places of a row differ
        if now is not None:
            yield out()

    return tidy(run)


def _within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is among known ones, which are in order."""
    at = np.searchsorted(known, x)
    return (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == x) if len(known) else np.zeros(len(x), bool)


class Tally:
    """How often each hash came. Names are in order; new ones lie apart until they are many."""

    def __init__(self):
        self.old = self.new = np.empty(0, np.uint64), np.empty(0, np.int64)

    @staticmethod
    def _merged(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        names, n = (np.concatenate(z) for z in zip(x, y))
        order = np.argsort(names, kind="stable")
        return names[order], n[order]

    def add(self, names: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Count names, in order and each once; whether each is new."""
        fresh = np.ones(len(names), bool)
        for known, counts in (self.old, self.new):
            hit = _within(names, known)
            counts[np.searchsorted(known, names[hit])] += n[hit]
            fresh &= ~hit
        self.new = self._merged(self.new, (names[fresh], n[fresh]))
        if len(self.new[0]) > max(1 << 15, len(self.old[0]) >> 2):
            self.old, self.new = self._merged(self.old, self.new), Tally().new
        return fresh

    def of(self, names: np.ndarray) -> np.ndarray:
        known, counts = self._merged(self.old, self.new)
        return counts[np.searchsorted(known, names)]


def _stretches(cells: int, most: int, shared, parts: int):
    """(bucket, langs, phrases, times) of a task's different stretches, in lists by BUCKETS buckets of their first two words. An empty phrase stands for all words of its language."""

    def passes(h: np.ndarray) -> np.ndarray:
        fit = np.arange(len(h))
        for row, cell in enumerate(_cells(h, cells)):
            cell = cell[fit]
            within, keep = cell // np.uint64(parts), np.zeros(len(cell), bool)
            part = cell % np.uint64(parts)
            for k, known in enumerate(shared.value[row]):
                own = np.flatnonzero(part == k) if parts > 1 else slice(None)
                keep[own] = known.has(within[own])
            fit = fit[keep]
        out = np.zeros(len(h), bool)
        out[fit] = True
        return out

    def listed(bucket: np.ndarray, langs: pa.Array, phrases: pa.Array, times: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        offsets = pa.array(np.append(first, len(bucket)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (langs.take(pa.array(order)), phrases.take(pa.array(order)), pa.array(times[order]))]
        return pa.record_batch([pa.array(bucket[first], pa.int32()), *lists], names=["bucket", "langs", "phrases", "times"])

    def run(batches):
        _forget()
        tally, held, size, weight, total = Tally(), [], 0, 0, {}
        whole = lambda: listed(np.concatenate([x[1] for x in held]), pa.concat_arrays([x[2] for x in held]), pa.concat_arrays([x[3] for x in held]), tally.of(np.concatenate([x[0] for x in held])))
        for b in batches:
            own = b.column(0)
            for words in _texts(b):
                for i, n in zip(own.take(pa.array(words.block.at)).to_pylist(), words.block.counts.tolist()):
                    total[i] = total.get(i, 0) + n
                length, name, lead = words.stretches(most, passes)
                place = np.flatnonzero(length)
                h, first, n = np.unique(name[place], return_index=True, return_counts=True)
                fresh = tally.add(h, n)
                at = place[first[fresh]]
                if len(at):
                    phrases = words.spelled(at, length[at])
                    held.append((h[fresh], (lead[at] % np.uint64(BUCKETS)).astype(np.int64), own.take(pa.array(words.block.at[words.owner[at]])), phrases))
                    size, weight = size + len(at), weight + phrases.nbytes
                if size >= CHUNK >> 2 or weight >= HELD_BYTES:
                    yield whole()
                    tally, held, size, weight = Tally(), [], 0, 0
        if size:
            yield whole()
        if total:
            yield listed(np.zeros(len(total), np.int64), pa.array(list(total), pa.string()), pa.array([""] * len(total)), np.array(list(total.values()), np.int64))

    return tidy(run)


class Automaton:
    """A shard's phrases over its own words, which are a symbol each."""

    def __init__(self, langs: pa.Array, phrases: pa.Array):
        salts = np.array([_salt(x) for x in langs.to_pylist()], np.uint64)
        words = [Words(block, salts[block.at]) for block in blocks(phrases, gap=IS_GAP)]
        keys = np.concatenate([w.keys for w in words]) if words else np.empty(0, np.uint64)
        self.keys, first = np.unique(keys, return_index=True)
        owner = np.concatenate([w.block.at[w.owner] for w in words]) if words else np.empty(0, np.int64)
        self.langs = [langs[i].as_py() for i in owner[first].tolist()]
        begin = np.cumsum([0, *(len(w.keys) for w in words)])
        part = np.searchsorted(begin, first, "right") - 1
        self.words = [words[k].block.word(i) for k, i in zip(part.tolist(), (first - begin[part]).tolist())]
        del words
        base = 2
        while base**DIGITS < len(self.keys):
            base *= 2
        place = np.arange(len(self.keys))[:, None] // base ** np.arange(DIGITS)[::-1] % base
        self.codes = (_FIRST + base * np.arange(DIGITS) + place).astype("<u4")  # an alphabet for each digit
        self.phrases, self.sizes = len(phrases), np.bincount(owner, minlength=len(phrases))
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        text = self.codes[np.searchsorted(self.keys, keys)].tobytes().decode("utf-32-le")
        end = (np.cumsum(self.sizes) * DIGITS).tolist()
        for i, (a, b) in enumerate(zip([0, *end], end)):
            self.tree.add_word(text[a:b], i)
        if len(phrases):
            self.tree.make_automaton()
        pairs = self._pairs(keys)[owner[1:] == owner[:-1]]
        self.pair_bits = 1 << max(10, (64 * len(pairs)).bit_length())
        self.pair_map = np.zeros(self.pair_bits, bool)
        self.pair_map[pairs & np.uint64(self.pair_bits - 1)] = True

    @staticmethod
    def _pairs(keys: np.ndarray) -> np.ndarray:
        """A hash of each word and the next."""
        return mixed(keys[:-1] * _ODD + keys[1:])

    def count(self, words: Words, of_phrase: np.ndarray, of_word: np.ndarray, times: np.ndarray | None = None) -> None:
        """Add what a block holds. times: the block's texts are stretches, of which each came so often; what begins a stretch counts, so often."""
        if not len(words.keys) or not self.phrases:
            return
        at = np.minimum(np.searchsorted(self.keys, words.keys), len(self.keys) - 1)
        known = self.keys[at] == words.keys
        first = np.diff(words.owner, prepend=-1) > 0
        if times is None:
            of_word += np.bincount(at[known], minlength=len(of_word))
        else:
            np.add.at(of_word, at[known & first], times[words.owner[known & first]])
        pair = self.pair_map[self._pairs(words.keys) & np.uint64(self.pair_bits - 1)] & known[1:] & known[:-1] & ~words.begins[1:]
        keep = np.zeros(len(at), bool)
        keep[1:] |= pair
        keep[:-1] |= pair
        keep = np.flatnonzero(keep)
        if not len(keep):
            return
        stop = np.ones(len(keep), bool)  # a delimiter before each run of words
        stop[1:] = ~pair[keep[1:] - 1]
        place = DIGITS * np.arange(len(keep)) + np.cumsum(stop)
        text = np.full(DIGITS * len(keep) + int(stop.sum()), _STOP, "<u4")
        for digit in range(DIGITS):
            text[place + digit] = self.codes[at[keep], digit]
        hits = np.fromiter(self.tree.iter(text.tobytes().decode("utf-32-le")), np.dtype("i8,i8"))
        end, hits = hits["f0"], hits["f1"]
        if times is None:
            of_phrase += np.bincount(hits, minlength=len(of_phrase))
        else:
            often = np.zeros(len(text), np.int64)  # of the stretch that begins at a symbol
            often[place[first[keep]]] = times[words.owner[keep[first[keep]]]]
            np.add.at(of_phrase, hits, often[end + 1 - DIGITS * self.sizes[hits]])


def _forget() -> None:
    """Workers live on: what an earlier pass held goes before the next needs its memory."""
    give_back()


def _shard(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of all phrases that begin the stretches in rows (lang, phrase, n), and of their first words."""
    known: dict[tuple[str, str], None] = {}
    langs, stretches, times = rows["lang"].to_pylist(), rows["phrase"].combine_chunks(), rows["n"].to_numpy()
    alone: dict[tuple[str, str], int] = {}
    for lang, stretch, n in zip(langs, stretches.to_pylist(), times.tolist()):
        end = stretch.find(" ")
        head = lang, stretch if end < 0 else stretch[:end]
        alone[head] = alone.get(head, 0) + n
        while end >= 0:
            end = stretch.find(" ", end + 1)
            known[lang, stretch if end < 0 else stretch[:end]] = None
    own = [pa.array([x[side] for x in known], pa.string()) for side in (0, 1)]
    tree = Automaton(*own)
    of_phrase, of_word = np.zeros(len(known), np.int64), np.zeros(len(tree.keys), np.int64)
    salts = np.array([_salt(x) for x in langs], np.uint64)
    for block in blocks(stretches, gap=IS_GAP):
        tree.count(Words(block, salts[block.at]), of_phrase, of_word, times[block.at])
    yield pa.record_batch([*own, pa.array(of_phrase)], names=["lang", "phrase", "n"])
    yield pa.record_batch([*(pa.array([x[side] for x in alone], pa.string()) for side in (0, 1)), pa.array(list(alone.values()), pa.int64())], names=["lang", "phrase", "n"])


def _counted(most: int, shard: int):
    """(lang, phrase, n): a bucket's sums, from lists of stretches in order of bucket. Equal rows of several shards are parts of a sum."""
    each = max(1, shard // max(1, most - 1))  # stretches that have shard phrases at most

    def folded(held: list[pa.Table]) -> pa.Table:
        rows = pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        return rows.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"])

    def counted(rows: pa.Table):
        for at in range(0, len(rows), each):
            yield from _shard(rows.slice(at, each))

    def run(batches):
        _forget()
        now, held, size = None, [], 0
        for b in batches:
            bucket = b.column(0).to_numpy()
            first = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            for x, y in zip(first, [*first[1:], len(bucket)]):
                if bucket[x] != now:
                    if held:
                        yield from counted(folded(held))
                    now, held, size = bucket[x], [], 0
                rows = b.slice(x, y - x)
                held.append(pa.table([rows.column(k).flatten() for k in (1, 2, 3)], names=["lang", "phrase", "n"]))
                size += len(held[-1])
                if size >= 4 * each:
                    held = [folded(held)]
                    size = len(held[0])
                    if size >= 2 * each:  # else it would soon be folded again
                        yield from counted(held[0])
                        held, size = [], 0
        if held:
            yield from counted(folded(held))

    return tidy(run)


def dealt(texts: DataFrame, least: int, most: int) -> DataFrame:
    """(bucket, langs, phrases, times): the stretches of texts (lang, text), with every phrase that occurs least times, and some that don't."""
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    cells = max(NARROW, (size // CELL_BYTES).bit_length())
    slices = texts.mapInArrow(_sketch(cells, least, most), "slice long, gaps binary, counts binary")
    often = staged(slices.repartition("slice").sortWithinPartitions("slice").mapInArrow(_frequent(cells, least), "cell long"), "phrase-cells")
    parts = min(MAPS, max(1, -(-often.where(F.col("cell") < 1 << cells).count() // MAP_CELLS)))
    within = often.select(F.shiftright("cell", cells).alias("row"), F.expr(f"cell % {parts}").alias("part"), F.expr(f"cell div {parts}").alias("cell"))
    maps = [[bit_map(within.where((F.col("row") == row) & (F.col("part") == part)), "cell", MAP_BITS) for part in range(parts)] for row in range(ROWS)]
    shared = texts.sparkSession.sparkContext.broadcast(maps)
    return texts.mapInArrow(_stretches(cells, most, shared, parts), "bucket int, langs array<string>, phrases array<string>, times array<long>")


def counts(texts: DataFrame, least: int = LEAST, most: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 2 to most words that occur least times, and of their words; and (lang, n), the number of all words."""
    sums = dealt(texts, least, most).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_counted(most, SHARD), "lang string, phrase string, n long")
    sums = sums.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))
    sums = staged(sums, "phrase-frequent")
    return sums.where("phrase != ''"), sums.where("phrase = ''").select("lang", F.col("f").alias("n"))


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, most: int = WORDS, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the first top phrases of 2 to most words that occur least times and whose words aren't inside a longer one with share hundredths of their count."""
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    often, total = counts(texts, least, most)
    phrases = often.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1)
    joined = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    size = F.size("words")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, size - F.col("k")).alias("tail"))
    of = lambda name: often.select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(f"{name}_phrase"), F.col("f").alias(name))
    cuts = cuts.join(of("l"), (F.col("lang") == F.col("l_lang")) & (F.col("head") == F.col("l_phrase"))).join(of("r"), (F.col("lang") == F.col("r_lang")) & (F.col("tail") == F.col("r_phrase")))
    score = F.expr(f"(cast(a as decimal(20, 0)) * {SCALE}) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))").alias("score")
    scored = cuts.select("lang", "phrase", "a", score, "k", "l", "r").groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("cut")).select("lang", "phrase", "cut.*")
    within = phrases.where(size > 2).select("lang", "f", "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    within = within.select("lang", "f", "words", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("at"))
    within = within.groupBy(F.col("lang").alias("i_lang"), joined(F.col("at"), F.col("m")).alias("i_phrase")).agg(F.max("f").alias("longer"))
    inside = F.expr(f"cast(longer as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {share}")
    kept = scored.join(within, (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("i_phrase")), "left").where(~F.coalesce(inside, F.lit(False)))
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    for part in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))], ["lang"]):  # no task ranks all phrases of a language
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("rank") <= top)
    return kept.join(total.withColumnRenamed("lang", "t_lang"), F.col("lang") == F.col("t_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
