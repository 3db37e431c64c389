"""Incremental ingestion with Structured Streaming: keyed, idempotent upserts per micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import last_delivery
from ..runtime import scratch


#: Buckets of the state; a batch rewrites only those it touches.
BUCKETS = 64


def upsert_stream(source: DataFrame, keys: Sequence[str], version: str, folder: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Drain a stream into the table under folder, newest version of each key; a replayed batch gives the same state.

    The state lies in buckets of the keys' hash. Batch n writes the buckets it touches to folder/n and a manifest that says which
    batch holds each bucket; it reads manifest n - 1, so nothing is overwritten in use and a replay starts from the same state.
    """
    spark = source.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        schema = batch.schema
        held = _manifest(spark, folder, number - 1) if number else {}
        rows = batch.withColumn("_bucket", bucket)
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most buckets rows
        old = [f"{folder}/{held[k]}/_bucket={k}" for k in touched if k in held]
        if old:
            rows = spark.read.schema(schema).parquet(*old).withColumn("_bucket", bucket).unionByName(rows)
        if touched:
            last_delivery(rows, [*keys, "_bucket"], version).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder}/{number}")
        now = sorted((held | dict.fromkeys(touched, number)).items())
        spark.createDataFrame(now, "bucket int, number long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest-{number}")

    source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _manifest(spark: SparkSession, folder: str, number: int) -> dict[int, int]:
    return {r["bucket"]: r["number"] for r in spark.read.parquet(f"{folder}/manifest-{number}").collect()}  # a row a bucket


def latest_state(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of all buckets as of the newest manifest."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    held = _manifest(spark, folder, max(int(n.split("-")[1]) for n in names if n.startswith("manifest-")))
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/{n}/_bucket={k}" for k, n in sorted(held.items())])


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total of a stream or table events(ts, event_type, value), with a watermark for late rows."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def drain(spark: SparkSession, path: str, schema, keys: Sequence[str], version: str) -> DataFrame:
    """A folder or file drained through upsert_stream into the shared folder; the resulting table."""
    base = scratch(spark, "stream")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        source = spark.readStream.schema(schema).option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    else:
        source = spark.readStream.schema(schema).parquet(path)
    upsert_stream(source, keys, version, f"{base}/state", f"{base}/checkpoint")
    return latest_state(spark, f"{base}/state", schema)
