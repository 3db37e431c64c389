"""Problem 8: a mixture of sources in target shares.

Method: every document gets a hash-random key; within each source the keys are range-partitioned, token counts are prefix-summed in
two levels (ranges, then rows), and the order is cut at the source's exact budget. A budget above the source's tokens takes whole
epochs first and cuts the last one. A document too long for what is left ends a sweep; further sweeps over the documents that still
fit use up the rest, until none fits. The total is the largest for which no source needs more than its max_repeats epochs, or a
given smaller one.

Sources are matched in lower case with one separator; documents without source, target or tokens aren't used. A source of the
targets without documents can't have its share: it is reported with 0 and doesn't bound the total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import settle

SEED = 17
#: Documents in one range of keys, about.
RANGE = 500_000


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """source, target_share, max_repeats, available, budget (tokens) of each row of the fixed table targets."""
    spelled = F.lower(F.regexp_replace(F.trim("source"), "[- ]", "_"))
    wanted = targets.select(spelled.alias("source"), "target_share", "max_repeats").dropDuplicates(["source"])
    have = sizes.filter("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    rows = wanted.join(have, "source", "left").fillna(0, ["available", "documents"])
    most = rows.filter("available > 0 and target_share > 0").agg(F.min(F.col("available") * F.col("max_repeats") / F.col("target_share")).alias("most")).first()["most"]
    size = min(x for x in (most or 0, total) if x is not None)
    return rows.withColumn("budget", F.when(F.col("available") > 0, F.least(F.floor(F.lit(float(size)) * F.col("target_share") + F.lit(1e-6)), F.col("available") * F.col("max_repeats"))).otherwise(0).cast("long"))


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture (source, doc_id, tokens, copies) of sizes(doc_id, source, tokens), and the budgets it keeps."""
    spark = sizes.sparkSession
    plan = settle(budgets(sizes, targets, total), "budgets")
    small = F.broadcast(plan.select("source", "available", "budget"))  # a row for each row of the fixed targets
    most = plan.agg(F.max("documents")).first()[0] or 0
    bits = max(0, (int(most) // RANGE).bit_length())
    epochs = F.floor(F.col("budget") / F.col("available"))
    rows = sizes.filter("tokens > 0").join(small, "source").withColumn("key", F.xxhash64(F.lit(SEED), "doc_id"))
    rows = rows.select("source", "doc_id", "tokens", "key", epochs.cast("int").alias("epochs"), (F.col("budget") - epochs * F.col("available")).cast("long").alias("left"))
    rows = rows.withColumn("range", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")).withColumn("more", F.lit(0))
    while True:  # each sweep takes a document of every source that has one left to fit
        rows = settle(_sweep(rows), "sweep")
        used, least = F.sum(F.when(F.col("more") == 2, F.col("tokens")).otherwise(0)), F.min(F.when(F.col("more") == 0, F.col("tokens")))
        state = rows.groupBy("source").agg((F.max("left") - used).alias("left"), least.alias("least")).collect()  # a row for each row of the fixed targets
        now = F.broadcast(spark.createDataFrame([(r["source"], r["left"]) for r in state], "source string, left long"))
        rows = rows.drop("left").join(now, "source").select("source", "doc_id", "tokens", "key", "epochs", "left", "range", F.least("more", F.lit(1)).alias("more"))
        if not any(r["least"] is not None and r["least"] <= r["left"] for r in state):
            break
    return rows.select("source", "doc_id", "tokens", (F.col("epochs") + F.col("more")).cast("int").alias("copies")).filter("copies > 0"), plan


def _sweep(rows: DataFrame) -> DataFrame:
    """One sweep: documents not yet taken that fit into what is left are prefix-summed by key and taken (more = 2) up to the cut."""
    size = F.when((F.col("more") == 0) & (F.col("tokens") <= F.col("left")), F.col("tokens")).otherwise(0)
    rows = rows.withColumn("size", size)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("n")).select("source", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("through", F.sum("size").over(inside)).join(sums, ["source", "range"])
    taken = (F.col("size") > 0) & (F.col("offset") + F.col("through") <= F.col("left"))
    return summed.select("source", "doc_id", "tokens", "key", "epochs", "left", "range", F.when(taken, 2).otherwise(F.col("more")).alias("more"))


def shares(mixture: DataFrame, plan: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens, most_copies of each target."""
    used = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    rows = plan.join(used, "source", "left").fillna(0, ["tokens", "most_copies"])
    total = F.sum("tokens").over(Window.partitionBy())
    return rows.select("source", "target_share", F.round(F.coalesce(F.col("tokens") / F.when(total > 0, total), F.lit(0.0)), 6).alias("actual_share"), "tokens", "most_copies", "max_repeats")
