"""Operator 11 against brute force over every window, and its suffix array's intervals against their definition."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from velora.llm import suffix_repeats
from velora.llm.queries import QUERIES
from velora.llm.suffix_repeats import maximal_repeats

SHAPE = "doc_id long, text string, kept string, spans int, th string, `at` int, mark double"


def docs(spark, rows):
    """With extra columns whose names clash with those of the operator."""
    return spark.createDataFrame([(i, t, "k", 3, "x", 1, 0.5) for i, t in rows], SHAPE)


def by_force(rows, order, window=100):
    """(doc_id, n_bytes, spans, kept) from every window of every text; order: the texts of an id in their order."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    place = lambda i, t, k: (i, order.get((i, t), 0), k)
    for i, t in texts:
        for k in range(len(t) - window + 1 if i is not None else 0):
            w = t[k : k + window]
            first[w] = min(first.get(w, place(i, t, k)), place(i, t, k))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - window + 1 if i is not None else 0):
            if first[t[k : k + window]] < place(i, t, k):
                gone[k] += 1
                gone[k + window] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        out.append((i, len(t), [tuple(x) for x in edge.reshape(-1, 2).tolist()], bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def order_of(spark, rows):
    return {(r.doc_id, (r.text or "").encode()): r.th for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()}


def found(df, **how):
    return sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix_repeats.dedup_bytes(df, **how).collect()), key=repr)


def made(seed, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choices("abcdefgh é日\0\n", k=k))
    passages = [text(k) for k in (99, 100, 101, 150, 300, 700)] + ["x" * 250, "ab" * 150, "abc " * 60]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p) + 1)))
            parts += [text(rng.randrange(60)), p if rng.random() < 0.6 else p[a:b]]
        rows.append((i * 7 % 100, "".join(parts)))
    base = text(3000)
    rows += [(200 + k, base[: 300 * k] + "!" + base[300 * k + 1 :]) for k in range(1, 8)] + [(300, base), (301, base), (302, base[:99]), (303, base + base)]
    return rows + [(400, None), (401, ""), (402, "short"), (None, base), (300, base), (301, passages[4]), (7, base[500:900])]


def test_suffix_repeats_by_force(spark, monkeypatch):
    rows = made(1)
    want = by_force(rows, order_of(spark, rows))
    assert sum(len(w[2]) for w in want) > 60
    assert found(docs(spark, rows)) == want
    monkeypatch.setattr(suffix_repeats, "SUFFIXES", 50)
    monkeypatch.setattr(suffix_repeats, "MANY", 2)  # nearly every mark is hot
    assert found(docs(spark, rows)) == want


def test_suffix_repeats_of_long_texts(spark, monkeypatch):
    """Texts in many segments, and other sizes of window and gram."""
    rows = made(2, 20)
    monkeypatch.setattr(suffix_repeats, "SEGMENT", 256)
    assert found(docs(spark, rows)) == by_force(rows, order_of(spark, rows))
    assert found(docs(spark, rows), window=30, gram=9) == by_force(rows, order_of(spark, rows), 30)


def test_suffix_repeats_of_nothing(spark):
    assert found(docs(spark, []).limit(0)) == []
    assert found(docs(spark, [(1, None), (None, None)])) == [(1, 0, [], b""), (None, 0, [], b"")]


def test_intervals_by_definition():
    """Every maximal repeat of a text, with all its occurrences, and nothing else."""
    rng = random.Random(3)
    for _ in range(40):
        text = "".join(rng.choices("ab", k=rng.randrange(2, 40)))
        n = len(text)
        sa = sorted(range(n), key=lambda i: text[i:])
        common = lambda a, b: next((k for k in range(n) if max(a, b) + k >= n or text[a + k] != text[b + k]), n)
        lcp = [common(a, b) for a, b in zip(sa, sa[1:])]
        left = [ord(text[i - 1]) if i else -1 for i in sa]
        got = {(text[sa[lo] : sa[lo] + length], tuple(sorted(sa[lo : hi + 1]))) for length, lo, hi, _ in maximal_repeats(lcp, left, sa, 2)}
        places = defaultdict(list)
        for k in range(2, n):
            for i in range(n - k + 1):
                places[text[i : i + k]].append(i)
        side = lambda p, at: {text[i + at] if 0 <= i + at < n else i + n for i in p}  # noqa: E731  a text's ends differ from all else
        want = {(s, tuple(p)) for s, p in places.items() if len(p) > 1 and len(side(p, -1)) > 1 and len(side(p, len(s))) > 1}
        assert got == want


def test_repeat_groups_hold_all_occurrences(spark, monkeypatch):
    """Each group's places hold one text, all places of that text are in it, and every recurring window is in a group."""
    rows = [r for r in made(4, 15) if r[0] not in (7, 300, 301)]
    texts = {i: (t or "").encode() for i, t in rows if i is not None}
    for many in (1000, 3):
        monkeypatch.setattr(suffix_repeats, "MANY", many)
        groups = defaultdict(set)
        for r in suffix_repeats.repeat_groups(docs(spark, rows)).collect():
            groups[r.repeat, r.length].add((r.doc_id, r.start))
        covered = set()
        for (_, length), places in groups.items():
            held = {texts[i][a : a + length] for i, a in places}
            assert len(held) == 1 and len(places) > 1
            covered |= {(i, a + k) for i, a in places for k in range(length - 99)}
            what = held.pop()
            every = {(i, a) for i, t in texts.items() for a in range(len(t) - length + 1) if t[a : a + length] == what}
            assert places == every
        windows = defaultdict(list)
        for i, t in texts.items():
            for a in range(len(t) - 99):
                windows[t[a : a + 100]].append((i, a))
        assert covered == {p for places in windows.values() if len(places) > 1 for p in places}


def test_suffix_repeats_query_by_force(spark, tmp_path):
    rows = made(5, 30)
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op11_suffix_repeats"](spark, str(tmp_path)).collect()), key=repr)
    want = [(i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in by_force(rows, order_of(spark, rows))]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("size", [0, 1, 99, 100, 101, 2_000_000])
def test_one_long_text(spark, size):
    """A text of one letter: all but its first window goes."""
    want = [(1, size, [(1, size)] if size > 100 else [], b"q" * min(size, 1 if size > 100 else 100))]
    assert found(docs(spark, [(1, "q" * size)])) == want


def test_gram_hashes_read_every_byte():
    data = np.frombuffer(bytes(range(200)), np.uint8)
    for gram in (8, 9, 13, 32, 100):
        h = suffix_repeats.gram_hashes(data, gram)
        assert len(set(h.tolist())) == len(data) - gram + 1
        for k in range(gram):
            other = data.copy()
            other[50 + k] ^= 1
            assert suffix_repeats.gram_hashes(other, gram)[50] != h[50]


def test_pieces_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(suffix_repeats, "SEGMENT", 64)
    texts = ["a" * 10, "b" * 300, "", "c" * 64, "d" * 65, "e" * 5]
    seen = defaultdict(list)
    for p in suffix_repeats.pieces(pa.array(texts), 20):
        for k, at in enumerate(p.at):
            assert bytes(p.data[p.bounds[k] : p.bounds[k + 1]]).decode() in texts[at]
            seen[int(at)] += list(range(p.base, p.base + p.bounds[k + 1] - p.bounds[k] - 19))
    assert {k: v for k, v in seen.items() if v} == {1: list(range(281)), 3: list(range(45)), 4: list(range(46))}
