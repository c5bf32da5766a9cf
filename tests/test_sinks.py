"""The sink of single files, the keyed cache and derived columns."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from velora.operators import motion
from velora.operators.derived import Derived, beside
from velora.sources import tables
from velora.sources.array_files import WAITING, write_arrays
from velora.sources.cache import cached, key_of


def clips(spark, n, first=0):
    return spark.createDataFrame([(f"clip{i}", [float(i), 1.5, -2.0, 4.0][: 2 + 2 * (i % 2)], [1 + i % 2, 2]) for i in range(first, first + n)], "id string, x array<double>, size array<int>")


def held(folder):
    """Hidden names are what is waiting, and what a file system keeps for itself."""
    return sorted(f for f in os.listdir(folder) if not f.startswith((".", "_")))


def test_arrays_go_out_and_come_back(spark, tmp_path):
    out = f"{tmp_path}/arrays"
    write_arrays(clips(spark, 7).repartition(3), out, "id", "x", "size")
    assert held(out) == [f"clip{i}.npy" for i in range(7)]
    assert np.load(f"{out}/clip3.npy").tolist() == [[3.0, 1.5], [-2.0, 4.0]]
    back = {r.clip: (r.shape, r["values"]) for r in tables.read_arrays(spark, out).collect()}
    assert back == {r.id: (r["size"], r.x) for r in clips(spark, 7).collect()}
    with pytest.raises(Exception, match="there already"):
        write_arrays(clips(spark, 2, 6), out, "id", "x")
    assert held(out) == [f"clip{i}.npy" for i in range(7)]
    write_arrays(clips(spark, 2, 7), out, "id", "x")
    write_arrays(clips(spark, 3, 5), f"file://{out}", "id", "x", overwrite=True)
    assert held(out) == ["clip5.npy", "clip6.npy", "clip7.npy"] and np.load(f"{out}/clip5.npy").shape == (4,)
    write_arrays(clips(spark, 1).limit(0), out, "id", "x")
    assert len(held(out)) == 3


@pytest.mark.parametrize("bad", [("clip1", [1.0], [1]), (None, [1.0], [1]), ("a/b", [1.0], [1]), ("new", None, [1]), ("new", [1.0], [5])])
def test_no_file_of_a_write_that_fails(spark, tmp_path, bad):
    """One bad row, or a name that another task has too: none of the others appears."""
    out = f"{tmp_path}/arrays"
    rows = clips(spark, 4).union(spark.createDataFrame([bad], "id string, x array<double>, size array<int>")).repartition(5)
    with pytest.raises(Exception):
        write_arrays(rows, out, "id", "x", "size")
    assert not os.path.exists(out) or held(out) == []


def test_a_task_that_is_tried_again_leaves_one_file():
    """In a session where tasks have three attempts: the first ones fail after they wrote a file."""
    import subprocess
    import sys
    import tempfile

    script = """
import sys, os
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from velora.sources.array_files import write_arrays
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def flaky(batches):
    for b in batches:
        yield b
    if TaskContext.get().attemptNumber() < 2:
        raise RuntimeError("lost")
rows = spark.range(6).repartition(2).selectExpr("concat('c', id) AS id", "array(double(id)) AS x")
write_arrays(rows.mapInArrow(flaky, rows.schema), sys.argv[1], "id", "x")
print(sorted(os.listdir(sys.argv[1])))
"""
    with tempfile.TemporaryDirectory() as folder:
        env = {**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
        env.pop("PYSPARK_GATEWAY_PORT", None), env.pop("PYSPARK_GATEWAY_SECRET", None)
        done = subprocess.run([sys.executable, "-c", script, folder], capture_output=True, text=True, env=env, timeout=120)
        assert [f for f in eval(done.stdout.strip().splitlines()[-1]) if not f.startswith(".")] == [f"c{i}.npy" for i in range(6)], done.stderr[-2000:]
        assert WAITING not in os.listdir(folder)


def test_cache_follows_inputs_and_parameters(spark, tmp_path):
    made = []
    source, root = f"{tmp_path}/in", f"{tmp_path}/cache"
    spark.range(5).write.parquet(source)

    def get(keep=1, **params):
        def make():
            made.append(params)
            return spark.read.parquet(source).withColumn("k", F.lit(params.get("k", 0)))

        return sorted((r.id, r.k) for r in cached(spark, root, make, params, [source], keep).collect())

    assert get(k=1) == get(k=1) == [(i, 1) for i in range(5)] and len(made) == 1
    assert get(k=2) == [(i, 2) for i in range(5)] and len(made) == 2
    assert [f for f in os.listdir(root) if not f.startswith(".")] == [f"key-{key_of(spark, {'k': 2}, [source])}"]
    spark.range(5, 7).write.mode("append").parquet(source)
    assert get(k=2) == [(i, 2) for i in range(7)] and len(made) == 3
    assert get(keep=2, k=3) and get(keep=2, k=2) and len(made) == 4
    with pytest.raises(FileNotFoundError):
        key_of(spark, {}, [f"{tmp_path}/nowhere"])


def test_cache_never_reads_what_was_interrupted(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/cache"
    spark.range(3).write.parquet(source)

    def broken():
        bad = F.udf(lambda x: 1 // 0)
        return spark.read.parquet(source).withColumn("b", bad("id"))

    with pytest.raises(Exception):
        cached(spark, root, broken, {}, [source])
    place = f"{root}/key-{key_of(spark, {}, [source])}"
    assert not os.path.exists(place)
    spark.range(1).write.parquet(place)
    os.remove(f"{place}/_SUCCESS")  # half a table under the key itself
    assert cached(spark, root, lambda: spark.read.parquet(source), {}, [source]).count() == 3


def test_derived_columns_are_made_once(spark):
    runs = []

    def counted(df):
        runs.append(1)
        return df.withColumn("c", F.col("a") + 1)

    rules = Derived().add("c", ["a"], counted).add("d", ["c"], F.col("c") * 2).add("e", ["c", "d"], F.col("c") + F.col("d")).add("a", ["c"], F.col("c") - 1)
    df = spark.createDataFrame([(1,), (5,)], "a int")
    assert [tuple(r) for r in rules.derive(df, ["e", "d"]).collect()] == [(1, 6, 4), (5, 18, 12)] and len(runs) == 1
    back = spark.createDataFrame([(2,)], "c int")
    assert [tuple(r) for r in rules.derive(back, ["a"]).collect()] == [(2, 1)]
    assert rules.plan(["a"], ["a"]) == []
    for has, wanted in ((["x"], ["e"]), (["a"], ["nothing"])):
        with pytest.raises(ValueError, match="no way"):
            rules.plan(has, wanted)


def test_derived_forms_of_a_pose(spark):
    """Joints from features or features from joints, whichever is there."""
    rng = np.random.default_rng(1)
    rows = [("a", f, rng.normal(size=66).tolist()) for f in range(4)]
    poses = spark.createDataFrame(rows, "clip string, frame int, pose array<double>")
    rules = Derived().add("features", ["pose"], beside(motion.local_features, "features")).add("pose", ["features"], beside(motion.from_local, "pose"))
    features = rules.derive(poses, ["features"])
    assert features.columns == ["clip", "frame", "pose", "features"] and features.count() == 4
    again = rules.derive(features.drop("pose"), ["pose", "features"])
    assert again.columns == ["clip", "frame", "features", "pose"]
    twice = rules.derive(again.drop("features"), ["features"]).join(features.select("clip", "frame", F.col("features").alias("f")), ["clip", "frame"]).where("frame > 0").collect()
    whole = lambda f: [*f[:-3], np.sin(f[-3]), np.cos(f[-3]), *f[-2:]]  # noqa: E731  a turn counts up to full circles
    for r in twice:
        assert np.allclose(whole(r.features), whole(r.f), atol=1e-6)
