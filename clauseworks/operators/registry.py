"""The clause registry: scans, keyed merges, replace and delete, as DataFrame rewrites of keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

MODES = ("skip", "upsert", "error")


def last_delivery(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row a key: the one with the greatest version, without a window (a max over structs combines map-side)."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max(F.struct(F.col(version).alias("_v"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(others)]))
    out = rows.groupBy(*keys).agg(best.alias("_best"))
    return out.select(*keys, *[F.col(f"_best._{i}").alias(c) for i, c in enumerate(others)])


def with_norms(clauses: DataFrame, norms: DataFrame) -> DataFrame:
    """Clauses joined to their norm's full name."""
    return clauses.join(norms.select("norm_key", "norm_full").distinct(), "norm_key")


def clause_menu(clauses: DataFrame) -> DataFrame:
    """norm_key, position, clause_number, title: clauses with requirements in numeric order of their numbers, titles cleaned."""
    rows = clauses.filter("has_requirements = 1").select("norm_key", "clause_number", T.clean_title("clause_number", "clause_title").alias("title")).distinct()
    order = Window.partitionBy("norm_key").orderBy(T.clause_order("clause_number"), "clause_number", "title")
    return rows.withColumn("position", F.row_number().over(order))


def fetch(clauses: DataFrame, numbers: DataFrame) -> DataFrame:
    """Clauses whose number is in numbers(clause_number); blank numbers ask for nothing."""
    return clauses.join(numbers.filter(F.trim("clause_number") != "").select("clause_number").distinct(), "clause_number", "left_semi")


def of_families(clauses: DataFrame, families: Sequence[str]) -> DataFrame:
    """Clauses with requirements of some families; the predicate reaches the scan."""
    return clauses.filter(F.col("top_level_family").isin(list(families)) & (F.col("has_requirements") == 1))


def merge_parts(chunks: DataFrame) -> DataFrame:
    """One clause of its chunk parts: texts joined by blank lines in order, any requirement flag, first title."""
    part = F.struct("chunk_index", "page", "chunk_id", "text", "title")
    return (
        chunks.groupBy("norm_key", "clause_number")
        .agg(F.array_sort(F.collect_list(part)).alias("p"), F.max(F.col("has_requirements").cast("int")).alias("has_requirements"))
        .select("norm_key", "clause_number", "has_requirements", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), F.get("p", F.lit(0))["title"].alias("title"))
    )


def write_norms(existing: DataFrame, incoming: DataFrame, mode: str = "skip") -> DataFrame:
    """The table after a write of whole norms: skip keeps norms already there, upsert replaces them, error refuses."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "error" and not incoming.join(existing, "norm_key", "left_semi").isEmpty():
        raise RuntimeError("norm already present")
    if mode == "upsert":
        return existing.join(incoming.select("norm_key").distinct(), "norm_key", "left_anti").unionByName(incoming)
    return existing.unionByName(incoming.join(existing.select("norm_key").distinct(), "norm_key", "left_anti"))


def delete_norms(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Cascade: rows of any table with norm_key, without the norms named."""
    return table.join(keys.select("norm_key").distinct(), "norm_key", "left_anti")


def merge_tables(base: DataFrame, source: DataFrame, keys: Sequence[str], source_wins: bool) -> DataFrame:
    """Both tables, one row a key: the source's row wins (upsert) or the base's (insert or ignore)."""
    one, other = (source, base) if source_wins else (base, source)
    return one.unionByName(other.join(one.select(*keys).distinct(), list(keys), "left_anti"))


def migrate_legacy(rows: DataFrame) -> DataFrame:
    """Single-table rows brought to the keyed schema: language EN, empty version and the family derived where missing."""
    got = {c: F.col(c) for c in rows.columns}
    blank = lambda c: F.nullif(F.trim(got[c]), F.lit("")) if c in got else F.lit(None).cast("string")
    rows = rows.withColumns({"language": F.coalesce(blank("language"), F.lit("EN")), "norm_version": F.coalesce(got.get("norm_version", F.lit(None).cast("string")), F.lit("")), "top_level_family": F.coalesce(blank("top_level_family"), T.clause_family("clause_number"))})
    return rows.withColumn("norm_key", F.concat_ws(":", "norm_id", "norm_version", "language"))


def clause_counts(clauses: DataFrame) -> DataFrame:
    return clauses.groupBy("norm_key").agg(F.count("*").alias("clauses"), F.sum("has_requirements").alias("requirements"))


def violations(chunks: DataFrame) -> DataFrame:
    """row_key, rule: every rule a chunk(chunk_id, has_requirements, shall_count, token_count, content_type) breaks."""
    rules = F.array_compact(
        F.array(
            F.when(~F.col("chunk_id").rlike(r"^[^_]+_[^_]+_part\d+_p\d+$"), F.lit("chunk_id")),
            F.when(F.col("has_requirements") & (F.col("shall_count") <= 0), F.lit("requirement_without_shall")),
            F.when((F.col("token_count") < 3) & ~F.col("content_type").isin("structural", "informative"), F.lit("too_short")),
        )
    )
    return chunks.select(F.col("chunk_id").alias("row_key"), F.explode(rules).alias("rule"))


def lookup(points: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Points with the ids asked for."""
    return points.join(ids.select(key).distinct(), key, "left_semi")


def delete_points(points: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Points without those of the ids, as a rewrite."""
    return points.join(ids.select(key).distinct(), key, "left_anti")


def menus(menu: DataFrame) -> DataFrame:
    """norm_key, clauses: the clause menu as one ordered list a norm."""
    listed = F.array_sort(F.collect_list(F.struct("position", "clause_number", "title")))
    return menu.groupBy("norm_key").agg(F.transform(listed, lambda x: F.struct(x["clause_number"], x["title"])).alias("clauses"))


def norm_labels(documents: DataFrame, norms: DataFrame, key: str = "standard_id") -> DataFrame:
    """documents with norm_id, norm_full and norm_version of their standard; unknown ones get their name in capitals, their name and nothing."""
    known = norms.select(F.col("norm_full").alias(key), F.col("norm_id").alias("_id"), F.col("norm_version").alias("_version")).dropDuplicates([key])
    rows = documents.join(known, key, "left")
    return rows.select(*documents.columns, F.coalesce("_id", F.upper(key)).alias("norm_id"), F.col(key).alias("norm_full"), F.coalesce("_version", F.lit("")).alias("norm_version"))


def chunk_records(chunks: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep and the registry's columns of chunks(norm_id, clause_number, part, parts, page, text, keywords, ...): id, counts, flags and comma-joined lists."""
    shall, should, may, can, kind = T.modality("text")
    rows = chunks.withColumns({"_" + n: c for n, c in zip(("shall", "should", "may", "can", "kind"), (shall, should, may, can, kind))})
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",")
    return rows.select(
        *keep, T.chunk_id("norm_id", "clause_number", F.col("part"), F.col("page")).alias("chunk_id"), "norm_id", "clause_number", T.clause_family("clause_number").alias("clause_family"), T.parent_clause("clause_number").alias("parent_clause"),
        F.col("page").alias("page_number"), F.col("part").alias("chunk_index"), F.col("parts").alias("total_chunks"), T.word_count("text").alias("token_count"), F.col("_kind").alias("content_type"), F.col("_shall").alias("shall_count"), F.col("_should").alias("should_count"),
        (F.col("_shall") > 0).alias("has_requirements"), F.col("_may").alias("has_permissions"), (F.col("_should") > 0).alias("has_recommendations"), F.col("_can").alias("has_capabilities"), joined("keywords").alias("keywords"), joined(T.cross_references("text")).alias("related_clauses"),
    )
