"""Cut lineage by writing a table to the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a Parquet row group: a writer holds one in memory.
ROW_GROUP = 16 << 20
#: Rows of an Arrow batch with texts, which are long: an executor holds a batch for each task on both sides.
MOST_ROWS = 500
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_WRITTEN: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that setting is absent and all tasks run on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='velora-')}"
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    Unlike checkpoint() this computes the plan once, compresses the rows and gives Catalyst
    real sizes for its choice of joins. A lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/velora-{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    _WRITTEN[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small from now on; a session that asks for smaller ones keeps them."""
    rows = int(spark.conf.get(BATCH))
    if not 0 < rows <= MOST_ROWS:
        spark.conf.set(BATCH, MOST_ROWS)


def tables() -> set[str]:
    """The staged tables that exist now."""
    return set(_WRITTEN)


def drop(gone: set[str]) -> None:
    """Remove staged tables that no plan reads any more; a failure leaves the rest to be tried."""
    for path in gone:
        spark = _WRITTEN.pop(path, None)
        if spark is None:
            continue
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  best effort: the JVM may have ended before
            continue


@atexit.register
def _remove() -> None:
    """The tables of this driver go when it ends."""
    drop(tables())
