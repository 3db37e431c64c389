"""Readers and writers: explicit schemas, tenant partitioning, JSON registries, idempotent upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.hooks import check_collection
from ..operators.registry import merge_tables

BLOCKS = "doc string, page int, pos int, zone string, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double"
SUFFIXES = (".pdf", ".docx")


def read_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, content of the files with an accepted suffix; a decoder hook turns them into BLOCKS."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    wanted = F.lit(False)
    for s in suffixes:
        wanted |= F.endswith(F.lower("path"), F.lit(s))
    return rows.filter(wanted).select("path", "content")


def check_input(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> str:
    """The path, if it is there and of an accepted kind."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(path)
    if not path.lower().endswith(suffixes):
        raise ValueError(f"{path}: only {', '.join(suffixes)}")
    return path


def decoded(files: DataFrame, decoder, schema: str = BLOCKS) -> DataFrame:
    """path, error and the rows that decoder(path, content) gives of schema; a file of which it raises gives one row with the error. Columns that the decoder leaves out at the end are null."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames):
        import pandas as pd

        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                try:
                    rows = [(path, None, *r, *[None] * (len(names) - len(r))) for r in decoder(path, bytes(content))]
                except Exception as e:  # a broken file must not end the job
                    rows = [(path, f"{type(e).__name__}: {e}"[:200], *[None] * len(names))]
                yield pd.DataFrame(rows, columns=["path", "error", *names])

    return files.mapInPandas(run, f"path string, error string, {schema}")


def decode(files: DataFrame, decoder, schema: str = BLOCKS) -> DataFrame:
    """The decoded rows of the files that can be read."""
    return decoded(files, decoder, schema).filter("error is null").drop("path", "error")


def batch_report(rows: DataFrame) -> DataFrame:
    """path, status, error, rows of decoded(), a row a file, in the order of the paths."""
    by = rows.groupBy("path").agg(F.max("error").alias("error"), F.count_if(F.col("error").isNull()).alias("rows"))
    return by.select("path", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "error", "rows").orderBy("path")


def item_pages(items: DataFrame) -> DataFrame:
    """doc, page_texts of items(doc, page, pos, text): a text a page where items lie on two pages or more, else the whole cut at form feeds."""
    parts = lambda by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, "text"))), lambda x: x["text"]), "\n")
    by_page = items.groupBy("doc", "page").agg(parts(["pos"]).alias("text")).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]).alias("pages"), F.count("page").alias("n"))
    whole = items.groupBy("doc").agg(parts(["page", "pos"]).alias("whole"))
    return by_page.join(whole, "doc").select("doc", F.when(F.col("n") >= 2, F.col("pages")).otherwise(page_texts("whole")).alias("page_texts"))


def page_texts(text: str | F.Column):
    """Pages of a text: split at form feeds, else the whole."""
    return F.split(text, "\f")


def write_registry(rows: DataFrame, folder: str, stamp: str) -> str:
    """A timestamped JSON registry, and its name in the table of the latest one; returns the path."""
    path = f"{folder.rstrip('/')}/registry_{stamp}"
    rows.write.mode("error").json(path)
    rows.sparkSession.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").json(f"{folder.rstrip('/')}/latest")
    return path


def write_sections(rows: DataFrame, folder: str) -> None:
    """Sections partitioned by tenant, so that a tenant's read prunes to its folder."""
    rows.repartition("company_id").write.mode("append").partitionBy("company_id").parquet(folder)


#: Sections that a read returns at most.
READ_LIMIT = 2048


def read_sections(spark: SparkSession, folder: str, company: str, doc: str, limit: int = READ_LIMIT) -> DataFrame:
    """Sections of one document of one tenant in page order, limit at most; both keys are mandatory."""
    if not company or not doc:
        raise ValueError("company and document are mandatory")
    return spark.read.parquet(folder).filter((F.col("company_id") == company) & (F.col("doc_id") == doc)).orderBy("page_start", "section_id").limit(max(0, limit))


def is_ingested(spark: SparkSession, folder: str, company: str, doc: str) -> bool:
    """Whether the tenant's document has a section."""
    return not read_sections(spark, folder, company, doc, 1).isEmpty()


def write_collection(rows: DataFrame, folder: str, key: str, model: str, sparse_dimension: int) -> DataFrame:
    """Upsert of points by their deterministic id into a collection; made for another model or dimension it is refused. Returns its rows.

    The collection is kept as numbered snapshots, each with its sidecar row; a reader takes the newest.
    """
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    known = sorted(int(x.getPath().getName()) for x in fs.listStatus(where)) if fs.exists(where) else []
    new = points(rows, key)
    want = {"model": model, "sparse_dimension": sparse_dimension}
    if known:
        at = f"{folder}/{known[-1]}"
        check_collection(spark.read.json(f"{at}/sidecar").first().asDict(), model, sparse_dimension)
        new = merge_tables(spark.read.parquet(f"{at}/points"), new, ["point_id"], source_wins=True)
    at = f"{folder}/{known[-1] + 1 if known else 0}"
    new.write.parquet(f"{at}/points")
    spark.createDataFrame([want]).coalesce(1).write.json(f"{at}/sidecar")
    return spark.read.parquet(f"{at}/points")


def points(rows: DataFrame, key: str) -> DataFrame:
    """Rows with their deterministic point id, one a key."""
    return rows.withColumn("point_id", T.uuid5(F.col(key).cast("string"))).dropDuplicates(["point_id"])
