"""Operator 9: remove passages of WINDOW words or more that an earlier document has.

A window is WINDOW consecutive words. Of a window the PHRASE-word phrase with the smallest hash is its mark; equal windows have
equal marks, and neighbouring windows mostly share one, so marks are few. The steps:

1. Marks are counted over documents by hash; those of two or more may recur. A bit map of them, of bounded size, goes to a second pass over all
   texts, which spells out the marks that it lets through. Those that two or more documents spell alike are the confirmed phrases.
2. Every document that can hold a confirmed phrase is streamed through Aho-Corasick automata compiled from the table of confirmed phrases:
   documents come with the phrases that they may hold, and an automaton is a shard of these of SHARD_BYTES at most. Occurrences are where the
   automata find them; nothing else decides.
3. Occurrences that are marks are grouped into stretches: the windows that one mark stands for. Stretches are matched whole
   first; where a stretch as a whole has no smaller document, its windows are matched one by one, but only against one copy of each
   different stretch. So long copies cost a row for each stretch, not for each word.
4. Each document drops the words that its matched windows cover.

Phrases are compared as text. Stretches and windows are matched under one phrase by 64-bit hashes of their words, so that a clash would have to be one of
the few texts around one phrase. Nothing is capped: a phrase that a third of all documents hold is pre-aggregated
before each shuffle and its rows are split by Spark where they are joined.

Cases: null text: no words. Fewer than WINDOW words: nothing goes. Repeated rows of one doc_id: a window needs a smaller doc_id, so
they don't remove each other's words. Null ids neither lose words nor count. Extra columns don't matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velora.llm.staging import drop, staged, tables
from velora.llm.words import Block, blocks, gram_hashes, gram_starts, tidy

WINDOW, PHRASE = 50, 8
#: Bytes of phrases in one automaton, and of texts that come to it at a time.
SHARD_BYTES, TEXT_BYTES = 1 << 18, 1 << 18
#: Bits of the map for each mark that may recur, and its largest size: 16 MB.
BITS_EACH, MOST_BITS = 16, 1 << 27


def marks(hashes: np.ndarray, first: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of each text: its start, its text, and the start of its mark (the first of equal smallest phrases)."""
    start, counts = gram_starts(first, window)
    owner = np.repeat(np.arange(len(first) - 1), counts)
    if not len(start):
        return start, owner, start
    n = len(hashes)
    at = np.arange(n - phrase + 1)
    value = gram_hashes(hashes, at, phrase)
    # sliding minimum over window - phrase + 1 phrases, by doubling; the place is carried along
    span, best, place, reach = window - phrase + 1, value, at, 1
    while reach < span:
        step = min(reach, span - reach)
        a, b = best[: len(best) - step], best[step:]
        left = a <= b
        best, place = np.where(left, a, b), np.where(left, place[: len(place) - step], place[step:])
        reach += step
    return start, owner, place[start]


def stretches(start: np.ndarray, owner: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of runs of windows of one text with one mark."""
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (mark[1:] != mark[:-1])
    lo = np.flatnonzero(new)
    return lo, np.append(lo[1:], len(start))


def _marks(window: int, phrase: int):
    """(id, phrase hash) of each mark of each document."""

    def run(batches):
        for b in batches:
            ids, owners, names = b.column(0), [], []
            for block in blocks(b.column(1)):
                hashes = block.word_hashes()
                start, owner, mark = marks(hashes, block.first, window, phrase)
                lo, _ = stretches(start, owner, mark)
                owners.append(block.at[owner[lo]])
                names.append(gram_hashes(hashes, mark[lo], phrase))
            if owners:
                yield pa.record_batch([ids.take(pa.array(np.concatenate(owners))), pa.array(np.concatenate(names).view(np.int64))], names=["id", "phrase"])

    return tidy(run)


def _spell(block: Block, lo: int, hi: int) -> str:
    """Words lo to hi with one space before, between and after."""
    return " " + b" ".join(block.data[block.starts[lo] : block.ends[hi - 1]].tobytes().split()).decode() + " "


def _spelled(window: int, phrase: int, shared):
    """(phrase hash, phrase, smallest and largest id) of the marks that the bit map lets through, once for each batch."""

    def run(batches):
        bits, size = shared.value
        for b in batches:
            ids, found = b.column(0).to_numpy(), {}
            for block in blocks(b.column(1)):
                hashes = block.word_hashes()
                start, owner, mark = marks(hashes, block.first, window, phrase)
                lo, _ = stretches(start, owner, mark)
                at, names = mark[lo], gram_hashes(hashes, mark[lo], phrase)
                place = (names & np.uint64(size - 1)).astype(np.int64)
                maybe = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                for k, name, i in zip(at[maybe].tolist(), names[maybe].view(np.int64).tolist(), ids[block.at[owner[lo[maybe]]]].tolist()):
                    key = name, _spell(block, k, k + phrase)
                    had = found.get(key)
                    found[key] = (min(had[0], i), max(had[1], i)) if had else (i, i)
            h, text = zip(*found) if found else ((), ())
            first, last = zip(*found.values()) if found else ((), ())
            yield pa.record_batch([pa.array(h, pa.int64()), pa.array(text, pa.string()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["h", "spelled", "lo", "hi"])

    return tidy(run)


def _bit_map(often: DataFrame, each: int | None = None) -> tuple[np.ndarray, int]:
    """A map of the hashes in often (p): at most MOST_BITS, whatever their number. A set bit of another hash costs a row more, never a result."""
    n = often.count()
    size = min(MOST_BITS, 1 << max(15, ((each or BITS_EACH) * n - 1).bit_length() if n else 15))
    place = F.col("p").bitwiseAND(F.lit(size - 1)) + 1  # the built-in functions count from 1: buckets, and places over them
    rows = often.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits, width = np.zeros(size // 8, np.uint8), 1 << 12  # a bucket is 2**15 bits
    for r in rows:
        bits[(r.bucket - 1) * width : r.bucket * width] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits, size


class Shards:
    """Automata of phrases, each of SHARD_BYTES at most."""

    def __init__(self, phrases: list[str]):
        self.automata, held = [], SHARD_BYTES
        for p in phrases:
            if held + len(p) > SHARD_BYTES:
                self.automata.append(ahocorasick.Automaton(ahocorasick.STORE_INTS))
                held = 0
            self.automata[-1].add_word(p, len(p))
            held += len(p)
        for a in self.automata:
            a.make_automaton()

    def ends(self, text: str) -> np.ndarray:
        """Places in text where an occurrence of a phrase ends."""
        return np.fromiter((end for a in self.automata for end, _ in a.iter(text)), np.int64)


def _located(block: Block, wanted: list[list[str]], phrase: int) -> np.ndarray:
    """For each word of a block, whether an occurrence of a phrase begins there."""
    shards = Shards(sorted(set().union(*wanted)))
    found = np.zeros(len(block.starts) + 1, bool)
    for i, own in enumerate(wanted):
        lo, hi = block.first[i], block.first[i + 1]
        if own and hi - lo >= phrase:
            text = _spell(block, lo, hi)
            ends = shards.ends(text)
            if len(ends):
                gaps = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)  # gap k stands before word k
                found[lo + np.searchsorted(gaps, ends) - phrase] = True
    return found


def _stretch_rows(window: int, phrase: int):
    """One row for each stretch whose mark the automata locate: (id, phrase, hash of all its words, first window, number of windows, hashes of its windows)."""

    def run(batches):
        for b in batches:
            wanted = b.column(2).to_pylist()
            for block in blocks(b.column(1), TEXT_BYTES):
                found = _located(block, [wanted[i] or [] for i in block.at], phrase)
                if not found.any():
                    continue
                hashes = block.word_hashes()
                start, owner, mark = marks(hashes, block.first, window, phrase)
                lo, hi = stretches(start, owner, mark)
                own = found[mark[lo]]
                lo, hi = lo[own], hi[own]
                if not len(lo):
                    continue
                first, last = start[lo], start[hi - 1] + window
                whole = gram_hashes(hashes, first, last - first)
                n = hi - lo
                each = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                inner = gram_hashes(hashes, start[each], window).view(np.int64)
                offset = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
                yield pa.record_batch(
                    [b.column(0).take(pa.array(block.at[owner[lo]])), pa.array(gram_hashes(hashes, mark[lo], phrase).view(np.int64)), pa.array(whole.view(np.int64)), pa.array((first - block.first[owner[lo]]).astype(np.int32)), pa.ListArray.from_arrays(offset, pa.array(inner))],
                    names=["id", "phrase", "whole", "at", "inner"],
                )

    return tidy(run)


def _kept(window: int):
    """(id, text, matched runs of windows) to the digest columns, or the kept text."""

    def run(batches):
        for b in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for text, runs in zip(b.column(1), b.column(2).to_pylist()):
                words = [w for w in _words(text.as_py() or "")]
                gone = np.zeros(len(words) + 1, np.int64)
                for r in runs or ():
                    gone[r["at"]] += 1
                    gone[min(r["at"] + r["n"] + window - 1, len(words))] -= 1
                covered = np.cumsum(gone[:-1]) > 0
                kept = [w for w, c in zip(words, covered) if not c] if runs else words
                n_words.append(len(words)), n_removed.append(len(words) - len(kept))
                texts.append(" ".join(kept))
                digests.append(hashlib.sha256(texts[-1].encode()).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    return tidy(run)


def _words(text: str) -> list[str]:
    return [w.decode() for w in text.encode().split()]  # bytes.split() parts at exactly the six ASCII spaces


def confirmed_phrases(docs: DataFrame, held: DataFrame, window: int, phrase: int) -> DataFrame:
    """(c_h, spelled): the marks that two or more documents spell alike, with their hash."""
    often = held.groupBy("phrase").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select(F.col("phrase").alias("p"))
    often = staged(often, "substring-often")
    shared = docs.sparkSession.sparkContext.broadcast(_bit_map(often))
    rows = docs.mapInArrow(_spelled(window, phrase, shared), "h long, spelled string, lo long, hi long")
    alike = rows.groupBy("h", "spelled").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    return staged(alike.select(F.col("h").alias("c_h"), "spelled"), "substring-confirmed")


def matched_runs(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(r_id, runs): for documents (id, text) with windows that a smaller document has, where those windows start and how many follow on."""
    usable = docs.where("id is not null")
    held = staged(usable.mapInArrow(_marks(window, phrase), "id long, phrase long"), "substring-marks")
    confirmed = confirmed_phrases(usable, held, window, phrase)
    lists = held.distinct().join(confirmed, F.col("phrase") == F.col("c_h")).groupBy("id").agg(F.collect_list("spelled").alias("phrases")).withColumnRenamed("id", "l_id")
    rows = usable.join(lists, F.col("id") == F.col("l_id")).select("id", "text", "phrases")
    rows = staged(rows.mapInArrow(_stretch_rows(window, phrase), "id long, phrase long, whole long, at int, inner array<long>"), "substring-stretches")
    # whole stretches: the smallest document of each
    n = F.size("inner")
    wholes = rows.groupBy("phrase", "whole").agg(F.min("id").alias("first")).toDF("w_phrase", "w", "first")
    wholes = staged(wholes, "substring-wholes")
    judged = rows.join(wholes, (F.col("phrase") == F.col("w_phrase")) & (F.col("whole") == F.col("w"))).select("id", "phrase", "at", "inner", (F.col("first") < F.col("id")).alias("whole_gone"))
    judged = staged(judged, "substring-judged")
    done = judged.where("whole_gone").select("id", "at", n.alias("n"))
    # a phrase with one stretch only has nothing more to match; else one copy of each stretch offers its windows
    varied = staged(wholes.groupBy("w_phrase").agg(F.count("*").alias("kinds")).where("kinds > 1").select(F.col("w_phrase").alias("v")), "substring-varied")
    open_ = judged.where(~F.col("whole_gone")).join(varied, F.col("phrase") == F.col("v")).select("id", "phrase", "at", F.posexplode("inner").alias("k", "win"))
    open_ = staged(open_, "substring-windows")
    earliest = open_.groupBy("phrase", "win").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select(F.col("phrase").alias("e_phrase"), F.col("win").alias("e_win"), "first")
    single = open_.join(staged(earliest, "substring-earliest"), (F.col("phrase") == F.col("e_phrase")) & (F.col("win") == F.col("e_win"))).where("first < id").select("id", (F.col("at") + F.col("k")).alias("at"), F.lit(1).alias("n"))
    # a stretch that isn't the first of its kind has been dealt with above, so `first < id` holds for its windows too
    return done.union(single).groupBy("id").agg(F.collect_list(F.struct("at", "n")).alias("runs")).withColumnRenamed("id", "r_id")


def dedup_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256, kept): kept holds the words that stay, one space between."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    before = tables()
    runs = matched_runs(docs, window, phrase)
    used = tables() - before
    runs = staged(runs, "substring-runs")
    drop(used)
    rows = docs.join(runs, F.col("id") == F.col("r_id"), "left").select("id", "text", "runs")
    out = rows.mapInArrow(_kept(window), "id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.withColumnRenamed("id", id_col)
