"""Operator 8: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: density and number of lexicon words and of lexicon stems, how many of them stand near a
second-person word, capitals, punctuation, and obfuscation (letters mixed with signs or digits, drawn-out letters,
lexicon words behind such signs). The lexicon is the short fixed list below and what the labels teach: words and stems
that are far more frequent in texts marked toxic. It is cross-fitted, so that the trees never see a density that
their own label made. Boosting uses three quarters of the sample; the calibration is fitted on the rest.

The sample is bounded in rows only: SAMPLE_LABELS labelled rows in the order of a hash, of which a document's equal rows count once.
Executors read the sampled texts whole, for the words and stems of the lexicons as for the features; the driver gets what the lexicons
keep and one row of features for each text, and fits trees and calibration on those. Scoring reads whole texts too.

Cases: null and empty texts, and texts without words, get the lowest score that the calibration knows. No labels of one of the two kinds: the score is
their share (0.5 without labels). A doc_id with several labels counts as toxic if one of them is. Null labels don't count.
Repeated rows are scored alike. Extra columns pass through, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velora.llm.crf import cores
from velora.llm.staging import free, small_batches, staged
from velora.llm.words import LOWER, Block, blocks, rolling, tidy

SAMPLE_LABELS = 8000
ROUNDS, DEPTH, RATE, BINS, LEAST = 60, 3, 0.2, 32, 8
NEAR = 5
STEMS = (4, 5, 6)  # bytes
FOLDS = 4
WORD, STEM = 0, 1
#: Of words and of stems: the least number of toxic texts, and the log odds to exceed.
LEAST_TEXTS, LEAST_ODDS = (3, 4), (2.0, 2.5)
#: Insults that need no learning.
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "jerk", "dumm", "trottel", "abschaum", "imbécile", "crétin", "connard", "tonto", "imbécil", "basura")
#: Words of address.
SECOND_PERSON = ("you", "your", "yours", "you're", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "te", "ton", "ta", "vous", "votre", "usted", "tú", "ti", "vosotros", "ustedes")
FEATURES = ("words", "lexicon", "hits", "stems", "stem_hits", "weight", "near_you", "you", "capitals", "shouted", "exclaimed", "asked", "punctuation", "obfuscated", "drawn_out", "hidden")
_LEET = np.arange(256, dtype=np.uint8)
_LEET[list(map(ord, "01345789@$!|"))] = list(map(ord, "oieastbgasil"))
_ALPHA, _UPPER, _DIGIT, _SIGN = (np.zeros(256, bool) for _ in range(4))
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SIGN[list(map(ord, "@$*#%&+|!"))] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True


class Lexicon:
    """A set of 64-bit hashes with a weight each; a bit map answers most lookups."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order]
        self.map = np.zeros(1 << 20, bool)
        self.map[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        """Weight of each hash; 0 if it isn't there."""
        out = np.zeros(len(hashes))
        maybe = np.flatnonzero(self.map[(hashes >> np.uint64(44)).astype(np.int64)])
        if len(maybe) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            same = self.hashes[at] == hashes[maybe]
            out[maybe[same]] = self.weights[at[same]]
        return out


def _hash_words(words: tuple[str, ...]) -> np.ndarray:
    block = next(blocks(pa.array([" ".join(words)])))
    return block.word_hashes(lower=True)


@dataclass
class Lexicons:
    words: Lexicon
    stems: Lexicon


def _tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, has = cores(block)
    return start, end, has, block.hashes(start, end, lower=True)


def _stems(block: Block, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for n in STEMS:
        own = np.flatnonzero(end - start >= n)
        out.append((own, block.hashes(start[own], start[own] + n, lower=True)))
    return out


def _odds(bad, clean, n1: int, n0: int, log):
    return log((bad + 0.5) / (n1 + 1)) - log((clean + 0.5) / (n0 + 1))


def _held():
    """(kind, key, cell, n): in how many texts of a fold and kind (cell: twice the fold, one more for toxic texts) each word and stem is."""

    def once(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key once for each text."""
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        return key[new], doc[new]

    def run(batches):
        for b in batches:
            cell = 2 * b.column(0).to_numpy() + b.column(1).to_numpy()
            for block in blocks(b.column(2)):
                start, end, has, hashes = _tokens(block)
                doc, own_cell = block.text_of_word(), cell[block.at]
                pairs = [(WORD, hashes[has], doc[has]), *((STEM, h, doc[own]) for own, h in _stems(block, start, end))]
                for kind, key, at in pairs:
                    key, at = once(key, at)
                    found, back = np.unique(key, return_inverse=True)
                    place, n = np.unique(back * (2 * FOLDS) + own_cell[at], return_counts=True)
                    names = found[place // (2 * FOLDS)].view(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(n), kind)), pa.array(names), pa.array(place % (2 * FOLDS)), pa.array(n)], names=["kind", "key", "cell", "n"])

    return tidy(run)


def _lexicons(sampled: DataFrame) -> list[Lexicons]:
    """Words and stems far likelier in toxic texts, by the number of texts that hold them: without each fold, then of all."""
    texts = np.zeros((FOLDS, 2), np.int64)
    for r in sampled.groupBy("fold", "toxic").count().collect():
        texts[r.fold, r.toxic] = r["count"]
    left = lambda cells: [sum(x for j, x in enumerate(cells) if j != k) for k in range(FOLDS + 1)]
    n0, n1 = left(texts[:, 0].tolist()), left(texts[:, 1].tolist())
    held = sampled.select("fold", "toxic", "text").mapInArrow(_held(), "kind long, key long, cell long, n long")
    cell = lambda c: F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}")
    held = held.groupBy("kind", "key").agg(*[cell(c) for c in range(2 * FOLDS)])
    clean, bad = (left([F.col(f"c{2 * k + t}") for k in range(FOLDS)]) for t in (0, 1))
    wanted = F.lit(False)
    for kind in (WORD, STEM):  # what none of the lexicons keeps stays with the executors; the last word on equal odds is below
        for k in range(FOLDS + 1):
            wanted |= (F.col("kind") == kind) & (bad[k] >= LEAST_TEXTS[kind]) & (_odds(bad[k], clean[k], n1[k], n0[k], F.log) > LEAST_ODDS[kind] - 1e-9)
    rows = np.array([tuple(r) for r in held.where(wanted).collect()], np.int64).reshape(-1, 2 + 2 * FOLDS)
    fixed, out = _hash_words(INSULTS), []
    clean, bad = (left([rows[:, 2 + 2 * k + t] for k in range(FOLDS)]) for t in (0, 1))
    for k in range(FOLDS + 1):
        score = _odds(bad[k], clean[k], n1[k], n0[k], np.log)
        words, stems = ((rows[:, 0] == kind) & (bad[k] >= LEAST_TEXTS[kind]) & (score > LEAST_ODDS[kind]) for kind in (WORD, STEM))
        w, s = rows[words, 1].view(np.uint64), score[words]
        rest = fixed[~np.isin(fixed, w)]
        out.append(Lexicons(Lexicon(np.append(w, rest), np.append(s, np.full(len(rest), 3.0))), Lexicon(rows[stems, 1].view(np.uint64), score[stems])))
    return out


_YOU = None


def describe(lex: Lexicons, block: Block) -> np.ndarray:
    """FEATURES of each text of a block."""
    global _YOU
    _YOU = _YOU or Lexicon(_hash_words(SECOND_PERSON), np.ones(len(SECOND_PERSON)))
    start, end, has, hashes = _tokens(block)
    n = len(hashes)

    def per_text(x: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1)
        np.cumsum(x, out=sums[1:])
        return sums[block.first[1:]] - sums[block.first[:-1]]

    def up_to(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=sums[1:])
        return sums

    count_bytes = lambda mask: np.diff(up_to(mask)[block.offsets])
    count_in_words = lambda sums: sums[block.ends] - sums[block.starts]
    weight = lex.words.weigh(hashes)
    stem = np.zeros(n)
    for own, h in _stems(block, start, end):
        np.maximum.at(stem, own, lex.stems.weigh(h))
    hit, stem_hit, you = weight > 0, stem > 0, _YOU.weigh(hashes) > 0
    either = hit | stem_hit
    at_you, at_hit = np.flatnonzero(you), np.flatnonzero(either)
    near = np.zeros(n, bool)
    if len(at_you) and len(at_hit):
        doc = block.text_of_word()
        for side in (-1, 0):
            k = np.clip(np.searchsorted(at_you, at_hit) + side, 0, len(at_you) - 1)
            near[at_hit[(np.abs(at_you[k] - at_hit) <= NEAR) & (doc[at_you[k]] == doc[at_hit])]] = True
    data = block.data
    alpha, upper, digit, sign = (count_in_words(up_to(m[data])) for m in (_ALPHA, _UPPER, _DIGIT, _SIGN))
    mixed_up = (alpha > 0) & (digit + sign > 0)
    hidden = np.zeros(n, bool)
    if mixed_up.any():
        own = np.flatnonzero(mixed_up)
        spelled, lo, hi = block.gathered(block.starts[own], block.ends[own])
        plain = rolling(_LEET[LOWER[spelled]]).slices(lo, hi)
        hidden[own] = (lex.words.weigh(plain) > 0) & ~hit[own]
    run = np.zeros(len(data), bool)
    if len(data) > 2:
        run[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _ALPHA[data[2:]]
    drawn = count_in_words(up_to(run)) > 0
    words = np.maximum(block.counts, 1)
    size = np.maximum(np.diff(block.offsets), 1)
    letters = np.maximum(count_bytes(_ALPHA[data]), 1)
    hits, stem_hits = per_text(hit), per_text(either)
    return np.column_stack([
        np.log1p(block.counts), hits / words, hits, stem_hits / words, stem_hits, per_text(weight + stem) / words, per_text(near) / np.maximum(stem_hits, 1), per_text(you) / words,
        count_bytes(_UPPER[data]) / letters, per_text((upper == alpha) & (alpha > 1)) / words, count_bytes(data == 33) / size, count_bytes(data == 63) / size, count_bytes(_PUNCT[data]) / size,
        per_text(mixed_up) / words, per_text(drawn) / words, per_text(hidden) / words,
    ])


@dataclass
class Trees:
    base: float
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # features and thresholds by heap place, leaf values

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, threshold, leaf in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss with histograms."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)])
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    trees = Trees(float(np.log(p / (1 - p))), [])
    score = np.full(len(y), trees.base)
    for _ in range(ROUNDS):
        q = 1 / (1 + np.exp(-score))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        at = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for node in range(2**DEPTH - 1):
            own = np.flatnonzero(at == node)
            best = (1e-6, 0, np.inf, BINS)
            if len(own) >= 2 * LEAST:
                total_g, total_h = g[own].sum(), h[own].sum()
                for f in range(x.shape[1]):
                    b = binned[own, f]
                    hg, hh, n = (np.cumsum(np.bincount(b, weights=w, minlength=BINS + 1))[:-1] for w in (g[own], h[own], None))
                    gain = hg**2 / (hh + 1) + (total_g - hg) ** 2 / (total_h - hh + 1) - total_g**2 / (total_h + 1)
                    gain[(n < LEAST) | (len(own) - n < LEAST) | (np.arange(BINS) >= len(cuts[f]))] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, cuts[f][k], k)
            feature[node], threshold[node] = best[1], best[2]
            at[own] = 2 * node + 1 + (binned[own, best[1]] > best[3])
        leaf = np.zeros(2**DEPTH)
        place = at - (2**DEPTH - 1)
        leaf[:] = -RATE * np.bincount(place, weights=g, minlength=2**DEPTH) / (np.bincount(place, weights=h, minlength=2**DEPTH) + 1)
        trees.nodes.append((np.append(feature, 0), np.append(threshold, np.inf), leaf))
        score += leaf[place]
    return trees


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; returns rising points to interpolate between: the mean place and the mean label of each pool, which is the least-squares rising fit."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for x, t in zip(raw[order], y[order]):
        pools.append([t, 1.0, x])  # sum, weight, sum of places
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, w, p = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + w, pools[-1][2] + p]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


@dataclass
class Model:
    lexicons: Lexicons
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for block in blocks(texts):
            if self.trees is None:
                out[block.at] = self.knots[1][0]
            else:
                score = np.clip(np.interp(self.trees.raw(describe(self.lexicons, block)), *self.knots), 0, 1)
                out[block.at] = np.where(block.counts > 0, score, np.clip(self.knots[1][0], 0, 1))
        return out


def _described(shared):
    """(id, digest, toxic, features): the lexicon of a text's features has not seen that text."""

    def run(batches):
        for b in batches:
            for k in range(FOLDS):
                part = b.filter(pa.array(b.column(2).to_numpy() == k))
                for block in blocks(part.column(4)):
                    own = part.slice(int(block.at[0]), len(block.at))
                    x = describe(shared.value[k], block)
                    x = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                    yield pa.record_batch([own.column(0), own.column(1), own.column(3), x], names=["doc_id", "digest", "toxic", "x"])

    return tidy(run)


def train(x: np.ndarray, y: np.ndarray, lexicons: Lexicons) -> Model:
    fit = np.random.default_rng(3).permutation(len(y)) % 4 != 0
    if y[fit].min() == y[fit].max() or y[~fit].min() == y[~fit].max():
        fit[:] = True
    trees = boost(x[fit], y[fit])
    own = ~fit if not fit.all() else fit
    return Model(lexicons, trees, isotonic(trees.raw(x[own]), y[own]))


def fit(docs: DataFrame, labels: DataFrame, train_ids: Column, rows: int = SAMPLE_LABELS) -> Model:
    """Train on at most rows labelled documents whose doc_id train_ids (an expression on doc_id) admits."""
    # at most `rows` rows of two integers: small enough to broadcast whatever the corpus
    own = labels.where(train_ids & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("long").alias("toxic"))
    own = own.select(F.col("doc_id").alias("t_id"), "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = F.coalesce("text", F.lit(""))
    got = docs.select("doc_id", text.alias("text")).join(F.broadcast(own), F.col("doc_id") == F.col("t_id"))
    got = staged(got.select("doc_id", F.sha2("text", 256).alias("digest"), "toxic", "text"), "toxicity-labelled")
    # documents with several texts may make more rows than labels: the bound holds for the rows too, chosen without their texts
    chosen = got.select("doc_id", "digest").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(rows)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).alias("fold")
    got = got.join(F.broadcast(chosen), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    got = staged(got.select("doc_id", "digest", fold, "toxic", "text"), "toxicity-sample")
    kinds = {r.toxic: r["count"] for r in got.groupBy("toxic").count().collect()}
    if len(kinds) < 2:
        return Model(Lexicons(*[Lexicon(np.empty(0, np.uint64), np.zeros(0))] * 2), None, (np.zeros(1), np.array([float(*kinds) if kinds else 0.5])))
    lexicons = _lexicons(got)
    shared = got.sparkSession.sparkContext.broadcast(lexicons[:FOLDS])
    found = got.mapInArrow(_described(shared), "doc_id long, digest string, toxic long, x array<double>")
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", "digest").select("toxic", "x").collect()  # `rows` rows at most
    return train(np.array([r.x for r in found]), np.array([r.toxic for r in found], float), lexicons[FOLDS])


def score(df: DataFrame, model: Model, cols: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """df's columns (or cols) with score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    cols = [c for c in (cols or df.columns) if c != "score"]
    (own,) = free(df.columns, "w_text")
    rows = df.select(F.col(f"`{text_col}`").cast("string").alias(own), *[F.col(f"`{c}`") for c in cols])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])

    def run(batches):
        for b in batches:
            yield pa.record_batch([*b.columns[1:], pa.array(shared.value.score(b.column(0)), pa.float64())], names=[*cols, "score"])

    small_batches(df.sparkSession)
    return rows.mapInArrow(tidy(run), f"{schema}, score double")
