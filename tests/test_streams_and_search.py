"""Streaming state, searches that leave rows out, quoted line ends, stems, cameras and conventions of poses."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from velora.operators import lexicon, motion, retrieval
from velora.sources.tables import read_delimited
from velora.streaming.running import Moments, moments_of, running_moments


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 3, 500)
    parts = [Moments.of(p) for p in np.split(x, [0, 1, 7, 300])] + [Moments()]
    for _ in range(5):
        rng.shuffle(parts)
        held = Moments()
        for p in parts:
            held = held.merged(p)
        n, mean, std = held.result()
        assert n == 500 and abs(mean - x.mean()) < 1e-6 and abs(std - x.std(ddof=1)) < 1e-6
    assert Moments().result() == (0, 0.0, 0.0) and Moments.of(np.array([np.nan, 4.0, np.inf])).result() == (1, 4.0, 0.0)


def test_a_stream_in_three_batches_is_the_table(spark, tmp_path):
    """Each batch updates the keys that it has; the last row of each key is what the whole table gives."""
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([rng.gauss(5, 2), None, float("nan")])) for _ in range(300)] + [("late", 7.0)]
    for k in range(3):
        spark.createDataFrame(rows[100 * k : 100 * k + 100 + (k == 2)], "k string, x double").coalesce(1).write.mode("append").json(f"{tmp_path}/in", ignoreNullFields=False)
    seen = []
    stream = spark.readStream.schema("k string, x double").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    query = running_moments(stream, "k", "x").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, i: seen.append({r.k: (r.n, r.mean, r["std"]) for r in df.collect()})).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert len(seen) == 3
    last = {}
    for batch in seen:
        last |= batch
    whole = {r.k: (r.n, r.mean, r["std"]) for r in moments_of(spark.read.schema("k string, x double").json(f"{tmp_path}/in"), "k", "x").collect()}
    assert last.keys() == whole.keys() == {"a", "b", "c", None, "late"}
    for k, v in whole.items():
        assert np.allclose(last[k], v)


@pytest.mark.parametrize("kind", ["tfidf", "dense"])
def test_searches_leave_out_what_is_excluded(spark, kind):
    rng = random.Random(3)
    by = (lambda: "".join(rng.choices("abcd ", k=25))) if kind == "tfidf" else (lambda: [rng.gauss(0, 1) for _ in range(5)])
    rows = [(i, by()) for i in range(40)]
    asked = [(100 + i, by()) for i in range(6)]
    a = spark.createDataFrame(rows, f"i long, x {'string' if kind == 'tfidf' else 'array<double>'}")
    b = spark.createDataFrame(asked, a.schema)
    full = retrieval.search(kind, a, b, "i", "i", "x", 40).collect()
    out = {(q, i) for q, _ in asked for i in rng.sample(range(40), rng.randrange(0, 30)) if q != 103} | {(999, 1)}
    exclude = spark.createDataFrame([*out, *list(out)[:5]], "q long, id long")
    got = {(r.q, r["rank"]): (r.id, r.score) for r in retrieval.search(kind, a, b, "i", "i", "x", 3, exclude).collect()}
    want = {}
    for q, _ in asked:
        kept = sorted(((r["rank"], r.id, r.score) for r in full if r.q == q and (q, r.id) not in out))[:3]
        want |= {(q, k): (i, s) for k, (_, i, s) in enumerate(kept, 1)}
    assert got == want
    assert retrieval.search(kind, a, b, "i", "i", "x", 3, exclude.limit(0)).count() == sum(r["rank"] <= 3 for r in full)


@pytest.mark.parametrize("prefix", [2, 3, 8])
def test_stems_are_joined_on_more_than_two_characters(spark, monkeypatch, prefix):
    """Every place of every stem, shorter and longer than what is joined on; many stems with one beginning meet no place that only begins alike."""
    monkeypatch.setattr(lexicon, "PREFIX", prefix)
    rng = random.Random(4)
    texts = [(i, "".join(rng.choices("ab한😀", k=60))) for i in range(8)] + [(8, ""), (9, "a"), (10, None)]
    stems = {texts[i % 8][1][k : k + n] for i, (k, n) in enumerate((rng.randrange(48), rng.randrange(1, 13)) for _ in range(120))} | {f"ab{i:03d}" for i in range(200)}
    lex = spark.createDataFrame([(s, f"g{k}", 1) for s in sorted(stems) for k in range(1 + len(s) % 2)], "stem string, gloss string, weight long")
    found = lexicon.occurrences(spark.createDataFrame(texts, "i long, t string"), lex, "i", "t")
    want = sorted((i, s, f"g{k}", at + 1) for i, t in texts if t for s in stems if len(s) > 1 for at in range(len(t)) if t.startswith(s, at) for k in range(1 + len(s) % 2))
    assert sorted((r.i, r.stem, r.gloss, r["at"]) for r in found.collect()) == want
    assert found.columns == ["i", "at", "stem", "gloss"]


def test_quoted_line_ends_stay_in_their_value(spark, tmp_path):
    at = f"{tmp_path}/c.csv"
    with open(at, "w", encoding="utf-8", newline="") as f:
        f.write('﻿file_id,text,gloss\n1,"one\ntwo","a ""b"", c"\n2,,\n3,"x\r\n\r\ny",z\n')
    got = [tuple(r) for r in read_delimited(spark, at).collect()]
    assert [(a, t.replace("\r\n", "\n"), g) for a, t, g in got] == [("1", "one\ntwo", 'a "b", c'), ("2", "", ""), ("3", "x\n\ny", "z")]
    with open(f"{tmp_path}/t.tsv", "w", encoding="utf-8") as f:
        f.write("a\tb\n1\t2\n3\t4\n")
    assert [tuple(r) for r in read_delimited(spark, f"{tmp_path}/t.tsv", lines=False).collect()] == [("1", "2"), ("3", "4")]


def test_a_lexicon_of_given_stems(spark):
    rows = [("went home", ["go", "home"], "go1 home"), ("gone", ["go"], "go1"), ("hoarse", ["hoarse"], "home"), ("x", None, "go1")]
    df = spark.createDataFrame(rows, "t string, s array<string>, g string")
    got = {(r.stem, r.gloss): r.weight for r in lexicon.build(df, "t", "g", least=0, stems="s").collect()}
    assert got == {("go", "go1"): 2, ("home", "home"): 1}
    plain = {(r.stem, r.gloss): r.weight for r in lexicon.build(df, "t", "g", least=0).collect()}
    assert plain == {("go", "go1"): 1, ("home", "home"): 1}


def test_cameras_by_least_squares(spark):
    """A known camera comes back from exact places; other places give what least squares of all equations gives; too few joints give none."""
    rng = np.random.default_rng(4)
    rows, want = [], []
    for k in range(12):
        n = int(rng.integers(3, 9))
        p, w = rng.normal(size=(n, 3)), rng.uniform(0, 1, n)
        t = np.array([*rng.normal(size=2), rng.uniform(5, 40)])
        image = 500.0 * (p[:, :2] + t[:2]) / (p[:, 2:] + t[2]) + 112 + (0 if k < 6 else rng.normal(size=(n, 2)) * 4)
        rows.append((k, p.ravel().tolist(), image.ravel().tolist(), w.tolist()))
        left, right = [], []
        for (x, y, z), (u, v), c in zip(p, image, np.sqrt(w)):
            left += [[500 * c, 0, c * (112 - u)], [0, 500 * c, c * (112 - v)]]
            right += [c * ((u - 112) * z - 500 * x), c * ((v - 112) * z - 500 * y)]
        want.append(np.linalg.lstsq(np.array(left), np.array(right), rcond=None)[0])
        assert k >= 6 or np.allclose(want[-1], t)
    rows += [(12, [1.0, 2.0, 3.0], [5.0, 6.0], [1.0]), (13, [1.0, 2.0, 3.0] * 2, [5.0, 6.0] * 2, [0.0, 0.0]), (14, [], [], [])]
    df = spark.createDataFrame(rows, "k int, p array<double>, i array<double>, w array<double>")
    got = {r.k: r.t for r in df.select("k", motion.camera_translation(F.col("p"), F.col("i"), F.col("w"), 500.0).alias("t")).collect()}
    for k, t in enumerate(want):
        assert np.allclose(got[k], t, rtol=1e-6)
    assert got[12] is got[13] is got[14] is None


def test_conventions_of_poses(spark):
    rng = np.random.default_rng(5)
    clips = {c: rng.normal(size=(3, 4, 3)) for c in "ab"}
    df = spark.createDataFrame([(c, f, p.ravel().tolist()) for c, x in clips.items() for f, p in enumerate(x)], "clip string, frame int, pose array<double>")
    for rebase in (True, False):
        for r in motion.standardised(df, [2, 0], (2, 0, 1), (1, -1, 1), 0.5, rebase).collect():
            make = lambda p: (p[[2, 0]][:, [2, 0, 1]] * [1, -1, 1] * 0.5)
            first = make(clips[r.clip][0])[0] if rebase else 0
            assert np.allclose(np.array(r.pose).reshape(2, 3), make(clips[r.clip][r.frame]) - first)


def test_facing_is_level_and_of_length_one(spark):
    from velora.functions import geometry as G

    hips = [[-1.0, 0.3, 0.0], [1.0, 0.1, 0.0]]  # right, left: it looks along z
    ahead = spark.range(1).select(G.forward_direction(*[F.array(*[F.lit(x) for x in v]) for v in (hips[0], hips[1], hips[0], hips[1])])).first()[0]
    assert math.isclose(math.hypot(*ahead), 1) and abs(ahead[0]) < 1e-12


def test_excluded_rows_do_not_widen_the_dense_search(spark, monkeypatch):
    """However many rows a query excludes, no task keeps more than k for it."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] , "i long, v array<double>")
    asked = rows.where("i < 3").union(spark.createDataFrame([(1, rng.normal(size=6).tolist())], "i long, v array<double>"))
    out = [(q, i) for q in range(3) for i in range(q, 90, q + 2)] + [(77, 5), (0, 1000)]
    kept, plain = [], retrieval.dense_top
    monkeypatch.setattr(retrieval, "dense_top", lambda *a, **how: kept.append(a[5]) or plain(*a, **how))
    got = retrieval.search("dense", rows, asked, "i", "i", "v", 4, spark.createDataFrame(out, "q long, id long")).collect()
    assert kept == [4]
    unit = lambda v: v / np.linalg.norm(v)
    for q in (0, 2):
        want = sorted(((-round(float(unit(x[q]) @ unit(x[i])), 6), i) for i in range(90) if (q, i) not in out))[:4]
        assert [(-r.score, r.id) for r in sorted(got, key=lambda r: r["rank"]) if r.q == q] == want
    assert {r.id for r in got if r.q == 1}.isdisjoint(i for q, i in out if q == 1)
