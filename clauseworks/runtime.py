"""Session-level services shared by every operator: table reading, worker imports, shared-folder tables, checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)
#: Bytes of a side that may be broadcast at most; beyond it operators take a shuffled join.
BROADCAST_LIMIT = 64 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies at the same path as on the driver (else ship it with --py-files)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); only where that is unset, as in tests, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm.get() if jvm.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="clauseworks-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_written: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by sweep()."""
    path = f"{shared_dir(spark).rstrip('/')}/clauseworks-{uuid.uuid4().hex}/{name}"
    _written.append((spark, path))
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may have ended before
        pass


def release(*tables: DataFrame) -> None:
    """Remove tables that settle() returned and that nothing reads any more."""
    for t in tables:
        _written.remove((t.sparkSession, t._settled))
        _remove(t.sparkSession, t._settled)


def sweep() -> None:
    """Remove the tables that settle() wrote."""
    while _written:
        _remove(*_written.pop())


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it each query's shuffle files go as the query ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


atexit.register(sweep)


def over_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run an Arrow batch function over every partition of df."""
    return df.mapInArrow(fn, schema)


def widen(scan: DataFrame) -> DataFrame:
    """A scan in at least as many partitions as there are cores; only a few small files are ever spread out. For plain scans only."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
