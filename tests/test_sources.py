"""Sources, sinks, whole-clip transforms and the stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from velora.operators import motion
from velora.sources import tables
from velora.streaming import moments


def test_separator_is_tried_again(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿a\tb\n1\t\n", encoding="utf-8")
    df = tables.read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["a", "b"] and [tuple(r) for r in df.collect()] == [("1", "")]
    with pytest.raises(FileNotFoundError, match="a.csv"):
        tables.read_delimited(spark, str(tmp_path / "b.csv"))


def test_lines_pages_and_json(spark, tmp_path):
    (tmp_path / "l.txt").write_text(" a \n\n b#x.npy\n")
    assert [r.value for r in tables.read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["a", "b#x.npy"]
    assert [tuple(r) for r in tables.read_prompts(spark, str(tmp_path / "l.txt")).collect()] == [("a", None), ("b", "x.npy")]
    (tmp_path / "p.txt").write_text("one\fтwo")
    assert [(r.page, r.raw) for r in tables.read_pages(spark, str(tmp_path / "p.txt")).collect()] == [(0, "one"), (1, "тwo")]
    (tmp_path / "j.jsonl").write_text('{"a": "x"}\n\n{"b": 2}\n')
    assert [tuple(r) for r in tables.read_jsonl(spark, str(tmp_path / "j.jsonl"), "a string, b int").collect()] == [("x", None), ("", 2)]
    (tmp_path / "c.txt").write_text("a man walks#a/DET man/NOUN#nan#2.5\nx#y\n")
    got = tables.read_captions(spark, str(tmp_path / "c.txt")).collect()
    assert [(r.clip, r.caption, r["from"], r["to"]) for r in got] == [("c", "a man walks", 0.0, 2.5), ("c", "x", 0.0, 0.0)]
    (tmp_path / "t.json").write_text(json.dumps({"T": {"s": {"class": "t2m", "input": ["a"], "output": ["b", "c"]}}}))
    assert tuple(tables.read_tasks(spark, str(tmp_path / "t.json")).first()) == ("T", "s", "t2m", ["a"], ["b", "c"])


def test_round_trips(spark, tmp_path):
    lex = spark.createDataFrame([("a", "A1", 3), ("a", "A2", 5)], "stem string, gloss string, weight long")
    tables.save_lexicon(lex, str(tmp_path / "lex"))
    assert [tuple(r) for r in tables.load_lexicon(spark, str(tmp_path / "lex")).collect()] == [("a", "A2", 5), ("a", "A1", 3)]
    made = []
    for _ in range(2):
        assert tables.cached(spark, str(tmp_path / "c"), lambda: made.append(1) or lex).count() == 2
    assert made == [1]
    tables.write_tsv(spark.createDataFrame([('a "q"', "x\ty")], "t string, g string").coalesce(1), str(tmp_path / "tsv"))
    part = next((tmp_path / "tsv").glob("part-*"))
    assert part.read_text() == 't\tg\na "q"\tx y\n'
    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(2, 3))
    assert [tuple(r) for r in tables.read_arrays(spark, str(tmp_path)).collect()] == [("m", [2, 3], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])]
    left = tables.remaining(spark.range(3), spark.range(1), "id")
    assert sorted(r.id for r in left.collect()) == [1, 2]


def test_sinks_and_bad_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb"), (2, None)], "k int, t string")
    tables.write_jsonl(rows, str(tmp_path / "j"))
    assert sorted(tuple(r) for r in tables.read_jsonl(spark, str(tmp_path / "j"), "k int, t string").collect()) == [(1, "a\nb"), (2, "")]
    tables.write_metrics(rows, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2 and len(list((tmp_path / "m").glob("part-*"))) == 1
    tables.write_stats(spark.createDataFrame([([1.0], [2.0])], "mean array<double>, std array<double>"), str(tmp_path / "s"))
    assert tuple(spark.read.parquet(str(tmp_path / "s")).first()) == ([1.0], [2.0])
    with pytest.raises(ValueError, match="one row"):
        tables.write_stats(rows, str(tmp_path / "s"))
    (tmp_path / "c.txt").write_text("x#y#0#nan\nx#y#bad#1\n")
    bad = tables.read_captions(spark, str(tmp_path / "c.txt"), keep_bad=True)
    assert sorted((r["from"] is None, r["to"]) for r in bad.collect()) == [(False, 0.0), (True, 1.0)]
    np.save(tmp_path / "m.npy", np.arange(2.0))
    prompts = spark.createDataFrame([("a", "x/m.npy"), ("b", None), ("c", "n.npy")], "text string, features string")
    got = tables.with_features(prompts, tables.read_arrays(spark, str(tmp_path))).collect()
    assert sorted((r.text, r["values"]) for r in got if r["values"]) == [("a", [0.0, 1.0])] and len(got) == 3


def test_sign_segments(spark, tmp_path):
    (tmp_path / "d").mkdir()
    points = [[float(i), 0.0, 0.0] for i in range(10)]
    good = {"metadata": {"video_fps": 30}, "landmarks": {t: points for t in tables.TIERS[:3]}, "sign_script": {"sign_gestures_both": [{"gloss_id": "G", "start": 0.05, "end": 0.05}, {"gloss_id": "H", "begin": 0.2, "stop": 9}]}}
    (tmp_path / "d" / "a.json").write_text(json.dumps(good))
    (tmp_path / "d" / "b.json").write_text(json.dumps({"landmarks": {}, "sign_script": {}}))
    (tmp_path / "x.json").write_text("{}")
    got = tables.read_signs(spark, str(tmp_path)).orderBy("segment").collect()
    assert [(r.gloss, r.lo, r.hi, len(r.motion), len(r.motion[0])) for r in got] == [("G", 2, 3, 1, 9), ("H", 6, 10, 4, 9)]
    assert tables.fullest_folder(spark, str(tmp_path)).first().folder.endswith("/d")
    (tmp_path / "d" / "c.json").write_text(json.dumps({**good, "landmarks": {**good["landmarks"], tables.TIERS[1]: []}}))
    assert tuple(tables.sign_audit(spark, str(tmp_path)).first()) == (4, 1, 2)


def test_local_features(spark):
    """Against arithmetic with complex numbers: the plane's turn is a product with a unit number; then back again."""
    rng = np.random.default_rng(0)
    body = motion.Body(left_hip=1, right_hip=2, left_shoulder=3, right_shoulder=4, feet=(5, 6))
    clips = {c: rng.normal(size=(n, 7, 3)).cumsum(0) for c, n in (("a", 12), ("b", 1), ("c", 3))}
    df = spark.createDataFrame([(c, k, p.ravel().tolist()) for c, x in clips.items() for k, p in enumerate(x)], "clip string, frame int, pose array<double>").repartition(3)
    local = motion.local_features(df, body=body)
    got = {(r.clip, r.frame): np.array(r.features) for r in local.collect()}
    back = {(r.clip, r.frame): np.array(r.pose).reshape(-1, 3) for r in motion.from_local(local).collect()}
    for c, x in clips.items():
        feet = x[:, [5, 6], 1].min(1)
        floor = feet.min() - np.log(0.5 + np.exp(feet.min() - feet.max()))
        plane = x[..., 0] + 1j * x[..., 2]
        across = plane[:, 2] - plane[:, 1] + plane[:, 4] - plane[:, 3]
        ahead = across / abs(across)  # cos and sin of the facing are its real and its negative imaginary part
        facing = np.conj(ahead)
        yaw = np.angle(facing)
        for k in range(len(x)):
            seen = (plane[k] - plane[k, 0]) * facing[k]
            step = ((plane[k] - plane[k - 1])[0] if k else 0) * facing[k]
            want = [x[k, 0, 1] - floor, *np.ravel([[s.real, h, s.imag] for s, h in zip(seen[1:], x[k, 1:, 1] - floor)]), yaw[k] - yaw[k - 1] if k else 0, np.real(step), np.imag(step)]
            assert np.allclose(got[c, k], want)
            home = (plane[k] - plane[0, 0]) * facing[0]  # the first frame at the origin, facing along z
            assert np.allclose(back[c, k], np.column_stack([home.real, x[k, :, 1] - floor, home.imag]))


def test_kinematics_and_scale():
    eye = np.broadcast_to(np.eye(3), (2, 3, 3, 3))
    offsets = np.array([[0, 0, 0], [0, 1, 0], [0, 2, 0]], float)
    assert np.allclose(motion.forward_kinematics(eye, offsets, np.zeros((2, 3)), [(0, 1, 2)])[0], [[0, 0, 0], [0, 1, 0], [0, 3, 0]])
    joints = np.array([[[0, 0, 0], [0, 1, 0], [0, 3, 0]]], float)
    assert np.allclose(motion.scaled_to(joints, (0, 1, 2), 6.0)[0, 2], [0, 6, 0])


def test_batches(spark):
    df = spark.createDataFrame([(k, [1.0] * k) for k in range(1, 6)], "id int, x array<double>")
    got = motion.batches(df, 2, "id", "x").orderBy("batch").collect()
    assert [(r.ids, r.lengths, [len(p) for p in r.padded]) for r in got] == [([1, 2], [1, 2], [2, 2]), ([3, 4], [3, 4], [4, 4]), ([5], [5], [5])]


def test_stream_of_moments(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 2).alias("kind"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = moments.windowed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "value", "kind")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("moments").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("moments").collect())) == sorted(map(tuple, moments.windowed(rows, "value", "kind").collect()))
