"""Tables that are kept under a key of what made them."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DONE = "_SUCCESS"


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(file, bytes, time of change) of a path's files, in order of name; hidden ones don't count. A path that isn't there is a FileNotFoundError."""
    store, at, _ = _store(spark, path)
    if not store.exists(at):
        raise FileNotFoundError(path)
    files, out = store.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        if not f.getPath().getName().startswith(("_", ".")):
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def key_of(spark: SparkSession, params: dict, inputs: list[str]) -> str:
    """A name for the parameters (what JSON can hold) and the inputs' files, with their sizes and times."""
    what = json.dumps([params, [[path, listed(spark, path)] for path in sorted(inputs)]], sort_keys=True)
    return hashlib.sha256(what.encode()).hexdigest()[:32]


def cached(spark: SparkSession, root: str, make: Callable[[], DataFrame], params: dict, inputs: list[str], keep: int = 1) -> DataFrame:
    """The table that make() gives, written below root once for each key of params and inputs.

    It is written beside and moved into place when it is whole, so that one that was interrupted is never read. Of older keys the newest keep - 1 stay; what another
    writer of the same key has put there first is taken."""
    store, top, path_of = _store(spark, root)
    place = path_of(top, f"key-{key_of(spark, params, inputs)}")
    if not store.exists(path_of(place, DONE)):
        waiting = path_of(top, f".waiting-{uuid.uuid4().hex}")
        make().write.parquet(waiting.toString())
        if store.exists(place) and not store.exists(path_of(place, DONE)):
            store.delete(place, True)  # not one of ours: they are moved whole
        if store.exists(place) or not store.rename(waiting, place):
            store.delete(waiting, True)
            if not store.exists(path_of(place, DONE)):
                raise OSError(f"{place.toString()} could not be put in place")
        others = [s for s in store.listStatus(top) if s.getPath().getName().startswith("key-") and s.getPath().getName() != place.getName()]
        for old in sorted(others, key=lambda s: -s.getModificationTime())[max(keep - 1, 0) :]:
            store.delete(old.getPath(), True)
    return spark.read.parquet(place.toString())
