"""Operator 1: language identification by a linear-chain conditional random field.

Every word has hashed affix and byte n-gram features, itself as a feature, and one for the language whose learned lexicon
holds it; learned transitions tie neighbouring words, so code-switched text is labelled word by word with posteriors from the
forward-backward recursions. A document's language is the one with the largest summed posterior over its
words with letters, its score that sum's share.

The recursions are exact for any length: a text is cut into segments whose transfer matrices are
multiplied out side by side, the messages between segments follow from those, and the posteriors
within segments from the messages. A long text thus takes few numpy steps and is never cut off.

Training uses a bounded sample of labelled rows (SAMPLE_DOCS documents in the order of a hash), each text whole. Executors cut
the sampled texts into words; the driver gets each text's word hashes and the different words once, and learns from sequences
spliced from stretches of different documents, which show the model changes of language.

Cases: null text or text without a letter (\\p{L}): `und`, score 0. No labelled row to learn from: `und`, score 0. Null labels don't count.
Ties: the language first in code point order. Repeated rows are predicted alike; a document's equal rows are learned from once. An empty
table gives an empty result. Extra columns pass through `identify`, whatever their names; columns of the result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velora.llm.staging import free, small_batches, staged
from velora.llm.words import LOWER, Block, Rolling, blocks, give_back, rolling, tidy

SAMPLE_DOCS = 2400
#: A word is in a language's lexicon if so many sampled documents of it hold it, and such a share of all that hold it.
LEXICON_DOCS, LEXICON_SHARE = 3, 0.9
BITS = 18
NGRAMS, AFFIXES = (2, 3, 4), (1, 2, 3, 4)
SEGMENT = 64
EPOCHS, RATE, STRETCH, LENGTH, BATCH = 3, 0.4, (3, 24), 48, 128
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_CORE = np.zeros(256, bool)
_CORE[65:91] = _CORE[97:123] = _CORE[128:] = True


@dataclass
class Lexicon:
    """Hashes of words, ascending, and the place of each one's language."""

    words: np.ndarray
    owner: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes it holds, and the language of each that it does."""
        if not len(self.words):
            return np.zeros(len(hashes), bool), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        own = self.words[at] == hashes
        return own, self.owner[at[own]]


@dataclass
class Model:
    classes: list[str]
    emission: np.ndarray  # (2**BITS, K) float32
    transition: np.ndarray  # (K, K)
    lexicon: Lexicon


def cores(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word without the marks around it; and whether it has a letter at all."""
    at = np.flatnonzero(_CORE[block.data])
    lo, hi = np.searchsorted(at, block.starts), np.searchsorted(at, block.ends)
    has = hi > lo
    start, end = block.starts.copy(), block.starts.copy()
    start[has], end[has] = at[lo[has]], at[hi[has] - 1] + 1
    return start, end, has


def features(roll: Rolling, start: np.ndarray, end: np.ndarray, lexicon: Lexicon) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of (feature indices, bounds by word): bounds[i] to bounds[i + 1] are word i's."""
    out, size = [], end - start
    shift = np.uint64(64 - BITS)

    def add(lo: np.ndarray, hi: np.ndarray, counts: np.ndarray, salt: int) -> None:
        h = roll.slices(lo, hi) * np.uint64(2 * salt + 0x9E3779B97F4A7C15)
        out.append(((h >> shift).astype(np.int32), np.concatenate(([0], np.cumsum(counts)))))

    for n in NGRAMS:
        counts = np.maximum(size - n + 1, 0)
        base = np.repeat(start - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
        lo = base + np.arange(len(base))
        add(lo, lo + n, counts, n)
    for n in AFFIXES:
        own = size >= n
        add(start[own], start[own] + n, own, 10 + n)
        add(end[own] - n, end[own], own, 20 + n)
    own = size > 0
    add(start[own], end[own], own, 30)
    own, language = lexicon.find(roll.slices(start, end))
    out.append((language, np.concatenate(([0], np.cumsum(own)))))  # the first places are the lexicons' own
    return out


def emissions(weights: np.ndarray, groups: list) -> np.ndarray:
    total = 0.0
    for index, bounds in groups:
        sums = np.zeros((len(index) + 1, weights.shape[1]))
        np.cumsum(weights[index], axis=0, out=sums[1:])
        total = total + sums[bounds[1:]] - sums[bounds[:-1]]
    return total


def posteriors(scores: np.ndarray, first: np.ndarray, transition: np.ndarray, pairs: bool = False):
    """Posterior of each label at each word; with pairs, also the expected transitions. first: bounds of the sequences."""
    n, k = scores.shape
    counts = np.diff(first)
    gamma = np.zeros((n, k))
    if n == 0:
        return (gamma, np.zeros((k, k))) if pairs else gamma
    psi = np.exp(np.clip(scores - scores.max(1, keepdims=True), -60, 0))
    a = np.exp(transition - transition.max())
    parts = -(-counts // SEGMENT)
    owner = np.repeat(np.arange(len(counts)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[:-1][owner] + nth * SEGMENT
    length = np.minimum(SEGMENT, first[1:][owner] - begin)
    order = np.argsort(-length, kind="stable")
    begin, length, opening = begin[order], length[order], nth[order] == 0
    alive = [int(np.searchsorted(-length, -t, "left")) for t in range(SEGMENT)]  # segments longer than t
    eye = np.eye(k)
    transfer = np.where(opening[:, None, None], eye, a) * psi[begin][:, None, :]
    for t in range(1, SEGMENT):
        if not (m := alive[t]):
            break
        transfer[:m] = (transfer[:m].reshape(-1, k) @ a).reshape(m, k, k) * psi[begin[:m] + t][:, None, :]
        if t % 8 == 0:
            transfer[:m] /= transfer[:m].max((1, 2), keepdims=True)
    transfer /= transfer.max((1, 2), keepdims=True)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    forth, back = np.ones((len(order), k)), np.ones((len(order), k))
    longest = np.argsort(-parts, kind="stable")
    base = (np.cumsum(parts) - parts)[longest]
    width = parts[longest]
    message = np.ones((len(longest), k))
    for s in range(int(width[0]) if len(width) else 0):
        m = int(np.searchsorted(-width, -s, "left"))
        seg = place[base[:m] + s]
        forth[seg] = message[:m]
        out = np.einsum("si,sij->sj", message[:m], transfer[seg])
        message[:m] = out / out.sum(1, keepdims=True)
    message = np.ones((len(longest), k))
    for s in range((int(width[0]) if len(width) else 0) - 1, -1, -1):
        m = int(np.searchsorted(-width, -s, "left"))
        seg = place[base[:m] + s]
        back[seg] = message[:m]
        out = np.einsum("sij,sj->si", transfer[seg], message[:m])
        message[:m] = out / out.sum(1, keepdims=True)
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    state = np.where(opening[:, None], forth, forth @ a) * psi[begin]
    state /= state.sum(1, keepdims=True)
    alpha[begin] = state
    for t in range(1, SEGMENT):
        if not (m := alive[t]):
            break
        state = (state[:m] @ a) * psi[begin[:m] + t]
        state /= state.sum(1, keepdims=True)
        alpha[begin[:m] + t] = state
    state = back
    for t in range(SEGMENT - 1, -1, -1):
        if not (m := alive[t]):
            continue
        now = state[:m]
        beta[begin[:m] + t] = now
        if t:
            new = (psi[begin[:m] + t] * now) @ a.T
            state[:m] = new / new.sum(1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    if not pairs:
        return gamma
    inner = np.ones(n, bool)
    inner[first[:-1][counts > 0]] = False
    j = np.flatnonzero(inner)
    right = psi[j] * beta[j]
    norm = np.einsum("si,ij,sj->s", alpha[j - 1], a, right)
    return gamma, a * (alpha[j - 1].T @ (right / norm[:, None]))


def spelled(block: Block) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of a block's words with letters: the hash of each, the bounds of each text's, and the different words by ascending hash."""
    start, end, has = cores(block)
    hashes = block.hashes(start[has], end[has], lower=True)
    _, where = np.unique(hashes, return_index=True)
    start, end = start[has][where], end[has][where]
    words = [block.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start, end)]
    return hashes, np.concatenate(([0], np.cumsum(has)))[block.first], words


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model | None:
    """From whole texts with their languages."""
    block = next(blocks(pa.array(texts, pa.string()), 1 << 40), None)
    if block is None:
        return None
    hashes, first, words = spelled(block)
    return learn([hashes[lo:hi] for lo, hi in zip(first, first[1:])], langs, pa.array(words, pa.string()), seed)


def lexicon_of(docs: list[np.ndarray], y: np.ndarray, names: np.ndarray, k: int) -> Lexicon:
    """Words (places in names) that are one language's by the documents that hold them."""
    held = np.zeros((len(names), k), np.int32)
    for own, c in zip(docs, y):
        held[np.unique(own), c] += 1
    best = held.argmax(1)
    most = held[np.arange(len(names)), best]
    own = (most >= LEXICON_DOCS) & (most >= LEXICON_SHARE * held.sum(1))
    return Lexicon(names[own], best[own])


def learn(docs: list[np.ndarray], langs: list[str], words: pa.Array, seed: int = 7) -> Model | None:
    """Adagrad on the conditional log-likelihood of spliced sequences. docs: each text's word hashes; words: the different words."""
    classes = sorted(set(langs))
    if not classes:
        return None
    label = {c: i for i, c in enumerate(classes)}
    k, rng = len(classes), np.random.default_rng(seed)
    block = next(blocks(words, 1 << 40), None)
    if block is None:
        return Model(classes, np.zeros((1 << BITS, k), np.float32), np.zeros((k, k)), Lexicon(np.empty(0, np.uint64), np.empty(0, np.int64)))
    start, end, _ = cores(block)
    roll = block.rolling(lower=True)
    names, where = np.unique(roll.slices(start, end), return_index=True)
    docs = [np.searchsorted(names, own) for own in docs]
    own_label = np.array([label[x] for x in langs])
    lexicon = lexicon_of(docs, own_label, names, k)
    groups = features(roll, start[where], end[where], lexicon)
    del roll, block
    word = np.concatenate(docs).astype(np.int32)
    edges = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    y = np.repeat(own_label, np.diff(edges))
    pieces = []
    for lo, hi in zip(edges, edges[1:]):
        while lo < hi:
            step = int(rng.integers(*STRETCH))
            pieces.append(np.arange(lo, min(lo + step, hi)))
            lo += step
    weights, transition = np.zeros((1 << BITS, k), np.float32), np.zeros((k, k))
    square, square_t = np.full((1 << BITS, k), 1e-6, np.float32), np.full((k, k), 1e-6)
    per = max(1, BATCH * LENGTH // ((STRETCH[0] + STRETCH[1]) // 2))
    for _ in range(EPOCHS if k > 1 else 0):
        turn = rng.permutation(len(pieces))
        for lo in range(0, len(turn), per):
            mine = [pieces[i] for i in turn[lo : lo + per]]
            at = np.concatenate(mine)
            first = np.unique(np.append(np.searchsorted(np.cumsum([len(m) for m in mine]), np.arange(0, len(at), LENGTH)), len(mine)))
            first = np.concatenate(([0], np.cumsum([len(m) for m in mine])))[first]
            w = word[at]
            index, word_of = [], []
            for flat, bounds in groups:
                n = bounds[w + 1] - bounds[w]
                index.append(flat[np.repeat(bounds[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
                word_of.append(np.repeat(np.arange(len(at)), n))
            index, word_of = np.concatenate(index), np.concatenate(word_of)
            scores = np.column_stack([np.bincount(word_of, weights=weights[index, c], minlength=len(at)) for c in range(k)])
            gamma, expected = posteriors(scores, first, transition, pairs=True)
            miss = gamma
            miss[np.arange(len(at)), y[at]] -= 1
            hit, back = np.unique(index, return_inverse=True)
            for c in range(k):
                g = np.bincount(back, weights=miss[word_of, c], minlength=len(hit))
                square[hit, c] += g * g
                weights[hit, c] -= RATE * g / np.sqrt(square[hit, c])
            inner = np.ones(len(at), bool)
            inner[first[:-1]] = False
            j = np.flatnonzero(inner)
            np.subtract.at(expected, (y[at[j - 1]], y[at[j]]), 1)
            square_t += expected**2
            transition -= RATE * expected / np.sqrt(square_t)
    return Model(classes, weights, transition, lexicon)


def label_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """(word, language, posterior) for each word of one text."""
    out = []
    for block in blocks(pa.array([text], pa.string())):
        gamma, _ = _label(model, block)
        out += [(block.word(i), model.classes[int(g.argmax())], float(g.max())) for i, g in enumerate(gamma)]
    return out


def _label(model: Model, block: Block) -> tuple[np.ndarray, np.ndarray]:
    start, end, has = cores(block)
    _, where, word = np.unique(block.hashes(start, end, lower=True), return_index=True, return_inverse=True)
    data, start, end = block.gathered(start[where], end[where])  # each different word once
    scores = emissions(model.emission, features(rolling(LOWER[data]), start, end, model.lexicon))
    return posteriors(scores[word], block.first, model.transition), has


def predict(model: Model | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    for block in blocks(texts):
        gamma, has = _label(model, block)
        sums = np.zeros((len(gamma) + 1, len(model.classes)))
        np.cumsum(gamma * has[:, None], axis=0, out=sums[1:])
        share = sums[block.first[1:]] - sums[block.first[:-1]]
        total = share.sum(1)
        for i in np.flatnonzero(total > 1e-9):
            text = block.data[block.offsets[i] : block.offsets[i + 1]]
            if (_CORE[text] & (text < 128)).any() or _LETTER.search(text.tobytes().decode()):
                best = int(share[i].argmax())
                langs[block.at[i]], scores[block.at[i]] = model.classes[best], float(min(1.0, share[i, best] / total[i]))
    return langs, scores


def _spelled_rows(batches):
    """(lang, words) with the hashes of a text's words, and rows of a different word each: its hash and itself."""
    names = ["h", "i", "digest", "lang", "words", "hash", "word"]
    for b in batches:
        for block in blocks(b.column(4)):
            hashes, first, words = spelled(block)
            own = b.slice(int(block.at[0]), len(block.at))
            n = len(own)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.record_batch([*own.columns[:4], lists, pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=names)
            k = len(words)
            empty = [pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()))]
            yield pa.record_batch([*empty, pa.array(np.unique(hashes).view(np.int64)), pa.array(words, pa.string())], names=names)


def fit(df: DataFrame, train_rows: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs: int = SAMPLE_DOCS) -> Model | None:
    """Train on at most docs of the labelled rows that train_rows admits, each text whole; ids are integers."""
    rows = df.where(train_rows & F.col(lang_col).isNotNull())
    # choose by id alone, so that a task sends the driver `docs` pairs of numbers at most, whatever it reads
    own = rows.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(id_col).cast("long").alias("i")).orderBy("h", "i").limit(docs)
    own = df.sparkSession.createDataFrame(own.collect(), own.schema)
    rows = rows.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("t"), F.sha2(F.col(text_col).cast("string"), 256).alias("digest"), F.col(lang_col).cast("string").alias("l"), F.col(id_col).cast("long").alias("d"))
    rows = staged(rows.join(F.broadcast(own.distinct()), F.col("d").eqNullSafe(F.col("i"))).select("h", "i", "digest", "l", "t"), "field-sample")
    # ids with several texts make more rows: the bound holds for rows too
    chosen = rows.select("h", "i", "digest", "l").distinct().orderBy("h", "i", "digest", "l").limit(docs)
    same = [rows[c].eqNullSafe(chosen[c]) for c in ("h", "i", "digest", "l")]
    rows = rows.join(F.broadcast(chosen), same, "left_semi").dropDuplicates(["h", "i", "digest", "l"])
    made = staged(rows.mapInArrow(tidy(_spelled_rows), "h long, i long, digest string, lang string, words array<long>, hash long, word string"), "field-words")
    texts = made.where("lang is not null").orderBy("h", "i", "digest", "lang").select("lang", "words").toArrow()
    lists = texts.column(1).combine_chunks()
    flat, edges = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    words = made.where("word is not null").groupBy("hash").agg(F.min("word").alias("word")).orderBy("hash").select("word").toArrow()
    model = learn([flat[lo:hi] for lo, hi in zip(edges, edges[1:])], texts.column(0).to_pylist(), words.column(0).combine_chunks())
    del texts, lists, flat, words
    give_back()
    return model


def identify(df: DataFrame, model: Model | None, text_col: str = "text", cols: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """df's columns (or cols) with the language and its score under names; columns of those names are replaced.

    Only texts go to Python, and only a language and a score come back.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    cols = [c for c in (cols or df.columns) if c not in names]

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            langs, scores = predict(shared.value, column.cast(pa.string()))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    # not deterministic, as far as the planner need know: it is then computed once for each row, whatever uses it
    label = F.arrow_udf(tidy(run), "struct<lang string, score double>").asNondeterministic()
    (out,) = free(df.columns, "w_field")
    small_batches(df.sparkSession)
    rows = df.select(*[F.col(f"`{c}`") for c in cols], label(F.col(f"`{text_col}`").cast("string")).alias(out))
    return rows.select(*[F.col(f"`{c}`") for c in cols], F.col(out).lang.alias(names[0]), F.col(out).score.alias(names[1]))
