"""Operator 13 against plain counting."""

import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from velora.llm import collocations
from velora.llm.collocations import Automaton, Words, collocations as mine

SHAPE = "doc_id long, text string, lang string, a int, phrase string, `rank` int, n long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """With extra columns whose names clash with those of the result."""
    return spark.createDataFrame([(i, t, lang, 1, "x", 2, 3) for i, (t, lang) in enumerate(rows)], SHAPE)


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER))]


def by_force(rows, least, top, most=4):
    f, n, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        for w in pieces(text):
            n[lang or "und"] += len(w)
            for k in range(1, most + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def found(df, **how):
    return sorted(tuple(r) for r in mine(df, **how).collect())


def made(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"{'W' if i % 3 else 'é'}{i}" for i in range(30)] + ["a", "A", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    set_phrases = [rng.sample(vocabulary, k) for k in (2, 2, 3, 4, 4)] + [["a"] * 5]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 20)):
            parts += rng.choice(set_phrases) if rng.random() < 0.5 else rng.choices(vocabulary, weights, k=2)
            parts.append(rng.choice(["", "", "", ".", ",", "!", "\n", "\r\n", "\x0b", " ;", "\t"]))
        rows.append((rng.choice([" ", "  ", "\t ", " "]).join(parts), rng.choice(["en", "en", "de", None])))
    return rows + [(None, "en"), ("", None), (" \t. ", "fr"), ("one two " * 40, "und"), (" a  a", "en")]


@pytest.mark.parametrize("least", [2, 5, 30])
def test_collocations_by_force(spark, least):
    rows = made(least)
    want = by_force(rows, least, 50)
    assert len(want) > 10
    assert found(docs(spark, rows), least=least, top=50) == want


def test_collocations_in_small_parts(spark, monkeypatch):
    """Many chunks, maps and shards change nothing; nor do three words at most."""
    rows = made(7)
    for name, value in (("CHUNK", 500), ("MAP_CELLS", 40), ("SHARD", 30)):
        monkeypatch.setattr(collocations, name, value)
    assert found(docs(spark, rows), least=3, top=2000) == by_force(rows, 3, 2000)
    assert found(docs(spark, rows), least=3, most=3) == by_force(rows, 3, 2000, 3)


def test_a_narrow_sketch_loses_nothing(spark, monkeypatch):
    """Counters that many phrases share only let more candidates through."""
    rows = made(8)
    monkeypatch.setattr(collocations, "NARROW", 4)
    monkeypatch.setattr(collocations, "CELL_BYTES", 1 << 30)
    assert found(docs(spark, rows), least=6) == by_force(rows, 6, 2000)


def test_collocations_of_nothing(spark):
    assert found(docs(spark, []).limit(0)) == []
    assert found(docs(spark, [(None, None), ("a b", "en")])) == []
    assert found(docs(spark, [("x y " * 300_000, "en")]), most=2) == by_force([("x y " * 300_000, "en")], 30, 2000, 2)


def test_slices_are_bounded():
    assert [collocations.slice_bits(c) for c in (16, 20, 28, 30, 34, 40)] == [16, 16, 20, 22, 22, 22]


def test_places_come_back():
    rng = np.random.default_rng(1)
    for k, least in ((1, 30), (50, 30), (50, 300), (5000, 30)):
        place = np.sort(rng.choice(1 << 22, k, replace=False))
        for p in (place, np.array([0]), np.array([0xFFFF, 0x1FFFE, 0x1FFFF])):
            n = rng.integers(1, least + 1, len(p))
            a, b = collocations.unpacked(*collocations.packed(p, n, least), least)
            assert a.tolist() == p.tolist() and b.tolist() == n.tolist()


def test_sums_are_exact_beyond_64_bits(spark, monkeypatch):
    """Counts whose products pass 64 bits."""
    huge = 3 * 10**13
    often = spark.createDataFrame([("en", "a b", huge), ("en", "a", huge + 7), ("en", "b", huge + 10**9)], "lang string, phrase string, f long")
    total = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    monkeypatch.setattr(collocations, "counts", lambda *_: (often, total))
    got = found(docs(spark, []))
    assert got == [("en", 1, "a b", huge, huge + 7, huge + 10**9, 10**15, 2000000 * huge // (2 * huge + 7 + 10**9))]


def test_automaton_counts_overlaps_and_stops():
    tree = Automaton(pa.array(["en", "en", "de"]), pa.array(["a a", "a a b", "a a"]))
    langs = ["en", "de", "en"]
    phrases, words = np.zeros(3, np.int64), np.zeros(len(tree.keys), np.int64)
    for block in collocations.blocks(pa.array(["A a a a b", "a a. a a b a", "a, a c a"]), gap=collocations.IS_GAP):
        tree.count(Words(block, np.array([collocations._salt(langs[i]) for i in block.at], np.uint64)), phrases, words)
    assert phrases.tolist() == [3, 1, 2]
    assert Counter(dict(zip(zip(tree.langs, tree.words), words.tolist()))) == {("en", "a"): 7, ("en", "b"): 1, ("de", "a"): 5}


def test_passes_do_not_grow_with_candidates(spark, monkeypatch):
    """Texts are read for their size, the sketch and the stretches, whatever the number of maps and shards."""
    rows, read = made(7), spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    for name, value in (("MAP_CELLS", 40), ("SHARD", 30)):
        monkeypatch.setattr(collocations, name, value)
    assert found(docs(spark, rows).mapInArrow(seen, SHAPE), least=3) == by_force(rows, 3, 2000)
    assert read.value == 3 * len(rows)


def test_automaton_counts_what_begins_a_stretch():
    tree = Automaton(pa.array(["en", "en", "en", "de"]), pa.array(["a a", "a a b", "a b", "a b"]))
    stretches, langs, times = ["a a b", "a b", "a a", "c", "a b"], ["en", "en", "en", "en", "de"], np.array([5, 7, 2, 9, 4])
    phrases, words = np.zeros(4, np.int64), np.zeros(len(tree.keys), np.int64)
    for block in collocations.blocks(pa.array(stretches), gap=collocations.IS_GAP):
        tree.count(Words(block, np.array([collocations._salt(langs[i]) for i in block.at], np.uint64)), phrases, words, times[block.at])
    assert phrases.tolist() == [7, 5, 7, 4]
    assert dict(zip(zip(tree.langs, tree.words), words.tolist())) == {("en", "a"): 14, ("en", "b"): 0, ("de", "a"): 4, ("de", "b"): 0}


@pytest.mark.parametrize("some", [False, True])
def test_stretches_in_small_parts(monkeypatch, some):
    """Stretches of full lists, folds and shards add up. Where maps leave phrases out, those that pass with all their parts are still whole."""
    monkeypatch.setattr(collocations, "CHUNK", 200)
    has = lambda h: (h % np.uint64(3) > 0) if some else np.ones(len(h), bool)
    shared = SimpleNamespace(value=[[SimpleNamespace(has=has)]] * collocations.ROWS)
    rows = [(t or "", lang or "und") for t, lang in made(9)]
    batches = [pa.record_batch([pa.array([x[k] for x in rows[i : i + 20]], pa.string()) for k in (1, 0)], names=["lang", "text"]) for i in range(0, len(rows), 20)]
    lists = pa.Table.from_batches(list(collocations._stretches(16, 4, shared, 1)(batches))).sort_by("bucket")
    assert len(lists) > lists["bucket"].combine_chunks().unique().__len__()
    got = Counter()
    for b in collocations._counted(4, 30)(lists.to_batches(max_chunksize=7)):
        for lang, phrase, n in zip(*(c.to_pylist() for c in b.columns)):
            got[lang, phrase] += n
    want, passing = Counter(), {}
    for text, lang in rows:
        for w in pieces(text):
            want[lang, ""] += len(w)
            for k in range(1, 5):
                want.update((lang, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    if some:
        for block in collocations.blocks(pa.array([p for _, p in want]), gap=collocations.IS_GAP):
            keys = list(want)
            words = Words(block, np.array([collocations._salt(keys[i][0]) for i in block.at], np.uint64))
            size, _, _ = words.stretches(4, lambda h: np.logical_and.reduce([has(c) for c in collocations._cells(h, 16)]))
            passing |= {keys[i]: size[first] == last - first for i, first, last in zip(block.at.tolist(), block.first, block.first[1:])}
        want = Counter({k: n for k, n in want.items() if passing[k] or not k[1]})
        assert 50 < len(want) < len(passing)
        assert all(got[k] == n for k, n in want.items())
    else:
        assert got == want


def test_tally_adds_up():
    rng, tally, want = np.random.default_rng(2), collocations.Tally(), Counter()
    for _ in range(40):
        names, n = np.unique(rng.integers(0, 200_000, 5000).astype(np.uint64), return_counts=True)
        assert tally.add(names, n).tolist() == [x not in want for x in names.tolist()]
        want.update(dict(zip(names.tolist(), n.tolist())))
    assert tally.of(np.array(list(want), np.uint64)).tolist() == list(want.values())


def test_phrases_are_spelled():
    block = next(collocations.blocks(pa.array(["Éa  B\tc. Dé", "", "e"]), gap=collocations.IS_GAP))
    words = Words(block, np.zeros(3, np.uint64))
    assert words.spelled(np.array([0, 1, 3, 4, 0]), np.array([3, 1, 1, 1, 2])).to_pylist() == ["Éa b c", "b", "dé", "e", "Éa b"]
