"""The queries pN_... of the training-data problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import language, markup, mixing, neardup, packing, residue, scans, splitting, terms, tokens


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.damage(scans.cleaned(table(spark, d, "parsed_sections")))[0].select("section_uid")


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(table(spark, d, "parsed_sections"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows, probes = terms.records(table(spark, d, "iso_clauses"), table(spark, d, "keyword_registry")), table(spark, d, "term_probes")
    return terms.answer_probes(terms.score_terms(terms.only_probed(rows, probes), terms.background(rows)), probes)


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = terms.records(table(spark, d, "iso_clauses"), table(spark, d, "keyword_registry"))
    return terms.score_terms(rows.dropDuplicates(["record_kind", "record_uid"]), terms.background(rows))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.kinds_of_blocks(markup.convert(table(spark, d, "parsed_documents"), texts=False))


def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = markup.convert(table(spark, d, "parsed_documents")).select("parsed_id", F.explode("blocks").alias("b"))
    return rows.select("parsed_id", "b.*").dropDuplicates(["parsed_id", "block_no"])


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_text(markup.convert(table(spark, d, "parsed_documents"))).dropDuplicates(["parsed_id"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(_records(spark, d))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    return neardup.representative_links(_records(spark, d))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(_records(spark, d))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    clauses = table(spark, d, "iso_clauses")
    model = language.fit(language.labelled_sample(clauses))
    return language.identify(language.records(clauses, table(spark, d, "parsed_sections")), model)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found_cases(_judged(spark, d))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).dropDuplicates(["record_kind", "record_uid"]).select("record_kind", "record_uid", "lang", F.round("confidence", 6).alias("confidence"), "segment_langs", "segment_confidence")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return language.records(table(spark, d, "iso_clauses"), table(spark, d, "parsed_sections")).drop("label")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(_records(spark, d)).select("record_kind", "record_uid")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(_records(spark, d))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_all(_sizes(spark, d), table(spark, d, "container_specs"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    specs = table(spark, d, "container_specs")
    return packing.fill(packing.pack_all(_sizes(spark, d), specs), specs)


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d), table(spark, d, "source_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*mixing.mix(_sizes(spark, d), table(spark, d, "source_targets")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.detect_residue(table(spark, d, "documents")).select("doc_id")


def p9_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each sort of evidence finds, and how many it alone does."""
    found = residue.detect_residue(table(spark, d, "documents"))
    return found.select(F.explode("kinds").alias("kind"), (F.size("kinds") == 1).cast("int").alias("alone")).groupBy("kind").agg(F.count("*").alias("documents"), F.sum("alone").alias("alone"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "documents")).select("doc_id", "source", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [p1_found, p1_repaired, p2_found, p2_scores, p3_found, p3_blocks, p3_clean, p4_found, p4_links, p4_groups, p5_found, p5_records, p6_found, p6_pieces, p7_containers, p7_fill, p8_mixture, p8_shares, p9_found, p9_evidence, p9_clean]
    return {f.__name__: f for f in names}


_RECORDS = "(SELECT DISTINCT 'clause' AS record_kind, clause_uid AS record_uid, text FROM iso_clauses UNION SELECT DISTINCT 'section', section_uid, raw_text FROM parsed_sections)"
_SPACES = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": rf"""WITH w AS (SELECT record_kind, record_uid, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {_RECORDS} WHERE text IS NOT NULL),
        s AS (SELECT DISTINCT record_kind, record_uid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 40)),
        n AS (SELECT record_kind, record_uid, count(*) AS n FROM s GROUP BY 1, 2),
        p AS (SELECT a.record_kind, a.record_uid AS uid_a, b.record_uid AS uid_b, count(*) AS c FROM s a JOIN s b ON a.record_kind = b.record_kind AND a.g = b.g AND a.record_uid < b.record_uid GROUP BY 1, 2, 3)
        SELECT p.record_kind, uid_a, uid_b FROM p JOIN n x ON p.record_kind = x.record_kind AND uid_a = x.record_uid JOIN n y ON p.record_kind = y.record_kind AND uid_b = y.record_uid WHERE c >= 0.5 * (x.n + y.n - c)""",
        "p6_found": rf"SELECT DISTINCT record_kind, record_uid FROM {_RECORDS} WHERE len(regexp_extract_all(text, '[^{_SPACES}]+')) > 600",
    }
