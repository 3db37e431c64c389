"""Ingestion of company sections: quality gate and counters, records with defaults, document checks, auditor verdicts, batch metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pages import json_array
from .segment import quality

MIN_CONFIDENCE, VECTOR_SIZE = 0.6, 1024
# Section types, clause families of a verdict, and the weights of a parse's signals.
TYPES = ("metadata", "scope", "definitions", "references", "process_diagram", "procedure_text", "record_form", "unknown")
FAMILIES = tuple(str(i) for i in range(4, 11))
PREVIEW = 300


class IngestionError(RuntimeError):
    """A vector of the wrong size, or a collection made for another size."""


def gated(sections: DataFrame, key: str, least: float = MIN_CONFIDENCE) -> DataFrame:
    """sections with tier and fate: quality_gate (all of a tier C document), empty_text, low_confidence or ingested."""
    empty = F.trim(F.coalesce("raw_text", F.lit(""))) == ""
    low = F.coalesce("extraction_confidence", F.lit(0.0)) < least
    fate = F.when(F.col("tier") == "C", "quality_gate").when(empty, "empty_text").when(low, "low_confidence").otherwise("ingested")
    return sections.join(quality(sections, key).select(key, "tier"), key).withColumn("fate", fate)


def counters(gate: DataFrame, key: str) -> DataFrame:
    """key, total, the sections of each fate, and the reason why nothing was ingested."""
    n = lambda fate: F.count_if(F.col("fate") == fate)
    rows = gate.groupBy(key).agg(F.count("*").alias("total"), n("quality_gate").alias("skipped_quality_gate"), n("empty_text").alias("skipped_empty_text"), n("low_confidence").alias("skipped_low_confidence"), n("ingested").alias("ingested"))
    return rows.withColumn("reason", F.when(F.col("skipped_quality_gate") > 0, "low_quality_document").when(F.col("ingested") == 0, "no_sections_ingested"))


def check_vectors(embedded: DataFrame, vector: str = "embedding", size: int = VECTOR_SIZE) -> DataFrame:
    """embedded, unless a vector has another size than the collection."""
    wrong = embedded.filter(F.col(vector).isNotNull() & (F.size(vector) != size)).select(F.size(vector).alias("n")).first()
    if wrong is not None:
        raise IngestionError(f"a vector has {wrong['n']} places, not {size}")
    return embedded


def section_payload(key: str = "section_id") -> Column:
    """A section's row as the JSON that is stored with its vector."""
    fields = ("section_id", "section_type", "title", "raw_text", "heading_level", "page_start", "page_end", "extraction_confidence", "doc_id", "company_id", "site_id")
    return F.to_json(F.struct(*fields))


def section_records(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """payloads read back: missing or odd values take their defaults (pages 0 and the first page, level 1, confidence 0, type unknown, texts empty)."""
    raw = "section_id string, section_type string, title string, raw_text string, heading_level string, page_start string, page_end string, extraction_confidence string"
    rows = payloads.withColumn("_p", F.from_json(payload, raw))
    number = lambda c, kind: F.col(f"_p.{c}").try_cast(kind)
    text = lambda c: F.coalesce(f"_p.{c}", F.lit("")).alias(c)
    start = F.coalesce(number("page_start", "int"), F.lit(0))
    kind = F.when(F.col("_p.section_type").isin(*TYPES), F.col("_p.section_type")).otherwise("unknown")
    return rows.select(
        *[c for c in payloads.columns if c != payload], text("section_id"), kind.alias("section_type"), text("title"), text("raw_text"), start.alias("page_start"), F.coalesce(number("page_end", "int"), start).alias("page_end"),
        F.coalesce(number("extraction_confidence", "double"), F.lit(0.0)).alias("extraction_confidence"), F.coalesce(number("heading_level", "int"), F.lit(1)).alias("heading_level"),
    )


def invariants(sections: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """key, rule: what each of documents(key, min_confidence, tier, low, path, file_format) breaks with its sections."""
    own = sections.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("section_id").alias("ids"), F.min("extraction_confidence").alias("least"), F.count_if(F.col("section_type") != "unknown").alias("typed"))
    rows = documents.join(own, key, "left")
    suffix = F.lower(F.regexp_extract(F.coalesce("path", F.lit("")), r"\.([^./]+)$", 1))
    rules = [
        ("empty", F.col("n").isNull()), ("duplicate_id", F.col("ids") < F.col("n")), ("min_confidence", F.abs(F.col("min_confidence") - F.col("least")) > 1e-9),
        ("low_flag", F.col("low") != ((F.col("tier") == "C") | (F.col("min_confidence") < 0.65))), ("suffix", suffix != F.col("file_format")), ("untyped", F.col("typed") == 0),
    ]
    return rows.select(key, F.explode(F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))).alias("rule"))


def previews(sections: DataFrame, longest: int = PREVIEW) -> DataFrame:
    """section_id, preview: the start of each section, as an auditor model is shown it."""
    return sections.withColumn("preview", F.substring(F.coalesce("raw_text", F.lit("")), 1, longest))


def verdicts(answers: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """key, section_id, llm_valid, predicted_clause_family from the JSON answers on whole documents; malformed items and answers give nothing, other families than FAMILIES null."""
    items = answers.select(key, F.inline(json_array(F.col(raw), "struct<id:string,valid:string,clause_family:string>")))
    known = items.filter(F.col("id").isNotNull() & F.col("valid").isin("true", "false")).dropDuplicates([key, "id"])
    valid = F.col("valid") == "true"
    return known.select(key, F.col("id").alias("section_id"), valid.alias("llm_valid"), F.when(valid & F.col("clause_family").isin(*FAMILIES), F.col("clause_family")).alias("predicted_clause_family"))


def audited(sections: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """sections with the verdicts on them and kept; a verdict that would drop every section of a document is ignored."""
    rows = sections.join(judged, [key, "section_id"], "left")
    left = rows.groupBy(key).agg(F.count_if(F.coalesce("llm_valid", F.lit(True))).alias("_left"))
    rows = rows.join(left, key)
    usable = F.col("_left") > 0
    return rows.withColumns({"llm_valid": F.when(usable, F.col("llm_valid")), "predicted_clause_family": F.when(usable, F.col("predicted_clause_family")), "kept": ~usable | F.coalesce("llm_valid", F.lit(True))}).drop("_left")


def parse_metrics(documents: DataFrame, text: str, pages: Column, title: Column, headings: Column, furniture: Column) -> DataFrame:
    """documents with character, word, page and heading counts and the accuracy score of their parse."""
    t = F.coalesce(text, F.lit(""))
    rows = documents.withColumns({"char_count": F.length(t), "word_count": F.size(F.regexp_extract_all(t, F.lit(r"(?U)\S+"), F.lit(0))), "pages": pages, "heading_count": headings, "title_detected": F.trim(F.coalesce(title, F.lit(""))) != "", "furniture_removed": furniture})
    each = F.when(F.col("pages") > 0, F.round(F.col("char_count") / F.col("pages"), 1))
    n, h = F.coalesce("chars_per_page", F.lit(0.0)), F.col("heading_count")
    score = (
        F.when(F.col("char_count") > 0, 0.40).otherwise(0.0) + F.when(F.col("pages") > 0, 0.15).otherwise(0.0) + F.when(F.col("title_detected"), 0.15).otherwise(0.0)
        + F.when(n >= 1000, 0.15).when(n >= 400, 0.10).when(n >= 100, 0.05).otherwise(0.0) + F.when(h >= 3, 0.10).when(h >= 1, 0.05).otherwise(0.0) + F.when(F.col("furniture_removed") > 0, 0.05).otherwise(0.0)
    )
    return rows.withColumn("chars_per_page", each).withColumn("accuracy_score", F.round(F.least(score, F.lit(1.0)), 4))


def batch_summary(metrics: DataFrame, error: Column) -> DataFrame:
    """total_files, success, errors, avg_accuracy_score (of the successes, 0 without any)."""
    return metrics.agg(F.count("*").alias("total_files"), F.count_if(error.isNull()).alias("success"), F.count_if(error.isNotNull()).alias("errors"), F.coalesce(F.round(F.avg(F.when(error.isNull(), F.col("accuracy_score"))), 4), F.lit(0.0)).alias("avg_accuracy_score"))
