"""Problem 7: filling containers of fixed capacity.

Method: bulk-synchronous best fit over ranges. Items are range-sorted by size and gaps by what they have left; in each step all
items of one size, largest first, sweep to the successor among the gaps (the smallest that fits), conflicts are resolved by rank
(the k-th item takes the k-th gap), the gaps are updated, and the next step follows. As items of one size and gaps of one
remainder are interchangeable, a step matches ranges of ranks: the sweep runs over tables with a row for each size and each
remainder, which the capacity bounds, and the items themselves are ranked and matched where they lie.

An item over the capacity is cut into full pieces and a rest. Items without tokens go into the first container. Repeated ids
count once; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import settle

#: Items that one ranking task sorts, about.
BUCKET = 500_000
PLAN = "size long, rank_start long, rank_end long, container_start long, each long"


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Plan rows (size, first rank, end rank, first container, items per container) for counts by size; all sizes within capacity."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_: list[int] = []
    plan, containers = [], 0

    def put(left: int, first: int, count: int) -> None:
        if not left or not count:
            return
        if left not in gaps:
            gaps[left] = []
            insort(open_, left)
        gaps[left].append((first, count))

    for size in sorted((s for s in histogram if s > 0), reverse=True):
        rank, end = 0, histogram[size]
        while rank < end:
            i = bisect_left(open_, size)
            if i < len(open_):
                left = open_[i]
                first, count = gaps[left].pop()
                if not gaps[left]:
                    del gaps[left]
                    open_.pop(i)
            else:
                left, first = capacity, containers
                count = -(-(end - rank) // (capacity // size))
                containers += count
            fits = left // size
            full = min(count, (end - rank) // fits)
            if full:
                plan.append((size, rank, rank + full * fits, first, fits))
                rank += full * fits
                put(left - fits * size, first, full)
            rest = end - rank
            if full < count and rest:  # fewer than fill one more container
                plan.append((size, rank, end, first + full, rest))
                rank = end
                put(left - rest * size, first + full, 1)
                full += 1
            put(left, first + full, count - full)
    if histogram.get(0):
        plan.append((0, 0, histogram[0], 0, histogram[0]))
    return plan


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece_no, size: whole documents, those over the capacity in full pieces and a rest."""
    last = F.greatest(F.lit(0), F.floor((F.col("tokens") - 1) / capacity)).cast("int")
    rows = sizes.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    return rows.select("doc_id", "piece_no", F.least(F.lit(capacity), F.col("tokens") - F.col("piece_no") * F.lit(capacity).cast("long")).cast("long").alias("size"))


def ranked(items: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Items with their rank within their size, by distributed prefix sums: a frequent size is spread over hash buckets."""
    n = items.count()
    spread = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(max(1, -(-n // bucket)))))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("size", "bucket").agg(F.count("*").alias("n")).select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("size", "bucket").orderBy("doc_id", "piece_no")
    return spread.withColumn("place", F.row_number().over(inside) - 1).join(offsets, ["size", "bucket"]).select("doc_id", "piece_no", "size", (F.col("offset") + F.col("place")).alias("rank"))


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """container_no, doc_id, piece_no, tokens of sizes(doc_id, tokens) for one capacity."""
    spark = sizes.sparkSession
    items = pieces(sizes, capacity)
    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    plan = spark.createDataFrame(best_fit(histogram, capacity), PLAN)
    places = ranked(items).join(F.broadcast(plan), "size").filter((F.col("rank") >= F.col("rank_start")) & (F.col("rank") < F.col("rank_end")))  # a few rows for each size: the capacity bounds the plan
    container = F.col("container_start") + F.floor((F.col("rank") - F.col("rank_start")) / F.col("each"))
    return places.select(container.cast("long").alias("container_no"), "doc_id", "piece_no", F.col("size").alias("tokens"))


def pack_all(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, container_no, doc_id, piece_no, tokens for each row of the fixed table specs(spec_id, capacity_tokens)."""
    out = None
    for r in specs.filter("capacity_tokens > 0").select("spec_id", "capacity_tokens").distinct().orderBy("spec_id").collect():
        one = pack(sizes, r["capacity_tokens"]).select(F.lit(r["spec_id"]).alias("spec_id"), "container_no", "doc_id", "piece_no", "tokens")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else sizes.sparkSession.createDataFrame([], "spec_id int, container_no long, doc_id long, piece_no int, tokens long")


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, containers, tokens, fill: how full the containers are."""
    used = packed.groupBy("spec_id").agg((F.max("container_no") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    return used.join(F.broadcast(specs.select("spec_id", "capacity_tokens").distinct()), "spec_id").select("spec_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"))
