"""The named queries of the core and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as T
from .operators import corpus, layout, pages, registry, retrieval, segment
from .runtime import table, widen

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# SQL fragments that several oracles share.
_CLAUSES = "(SELECT DISTINCT * FROM iso_clauses)"
_MARKUP = r"(?s)#+\s|<!--.*?-->|\*\*|\*|`|\[.*?\]"
_WORDS = rf"list_filter(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '{_MARKUP}', ' ', 'g')), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zà-ÿ]{{3,}}') AND NOT list_contains({_list(T.STOP_WORDS)}, w))"
_TERMS = f"(SELECT clause_uid, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS terms FROM (SELECT clause_uid, {_WORDS} AS w FROM {_CLAUSES}))"
_TOKENS = rf"(SELECT clause_uid, list_distinct(list_concat({_WORDS}, list_filter(string_split(regexp_replace(clause_number, '[^0-9]+', ' ', 'g'), ' '), lambda x: x <> ''))) AS tokens FROM {_CLAUSES})"
_INDEX = "(('0x' || right(md5(token), 5))::INTEGER & 131071)"
_ORDER = r"list_transform(string_split(clause_number, '.'), lambda x: coalesce(try_cast(nullif(regexp_extract(x, '^(\d+)', 1), '') AS INTEGER), 0))"
_TITLE0 = r"trim(replace(regexp_replace(coalesce(clause_title, ''), '^#+\s*', ''), chr(9), ' '))"
_TITLE1 = rf"(CASE WHEN starts_with({_TITLE0}, clause_number) THEN trim(substr({_TITLE0}, length(clause_number) + 1), ' .:-') ELSE {_TITLE0} END)"
_TITLE = f"(CASE WHEN {_TITLE1} = '' THEN clause_number WHEN length({_TITLE1}) > 80 THEN substr({_TITLE1}, 1, 77) || '...' ELSE {_TITLE1} END)"


# Clause texts without notes and examples, and counts in them.
_NOTE_FREE = rf"regexp_replace(regexp_replace(chr(10) || coalesce(text, ''), '{T.NOTE}', '', 'g'), '^\n', '')"
_COUNT = f"len(regexp_extract_all({_NOTE_FREE}, '(?i)\\b({{}})\\b'))"


def _clauses(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """clause_uid and some columns (else all) of each clause once: repeated deliveries are equal rows. Partitioned by the key the operators group by, and not coalesced, as text work follows."""
    rows = table(spark, d, "iso_clauses")
    rows = rows.select("clause_uid", *columns) if columns else rows
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "clause_uid").distinct()


def _sections(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """section_uid and some columns of each section once, as last delivered; only these columns are read and shuffled."""
    rows = table(spark, d, "parsed_sections").select("section_uid", "ingested_at", *columns)
    return registry.last_delivery(rows, ["section_uid"], "ingested_at").drop("ingested_at")


_SECTIONS = "(SELECT * FROM parsed_sections QUALIFY row_number() OVER (PARTITION BY section_uid ORDER BY ingested_at DESC) = 1)"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each clause as a chunk with what registry.violations asks for."""
    text = F.coalesce("text", F.lit(""))
    return _clauses(spark, d).select(
        F.concat("norm_id", F.lit("_"), "clause_number", F.lit("_part1_p1")).alias("chunk_id"), (F.col("has_requirements") == 1).alias("has_requirements"), T.modal_count(T.note_free(text), T.SHALL).alias("shall_count"), T.word_count(text).alias("token_count"), T.content_type(T.note_free(text)).alias("content_type")
    )


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return hybrid_top_k(spark, d)


# ---------------------------------------------------------------- scans and joins
@query(f"SELECT clause_uid, norm_full, clause_number FROM {_CLAUSES} JOIN (SELECT DISTINCT norm_key, norm_full FROM iso_norms) USING (norm_key)")
def clauses_with_norms(spark, d):
    return registry.with_norms(_clauses(spark, d, "norm_key", "clause_number"), table(spark, d, "iso_norms")).select("clause_uid", "norm_full", "clause_number")


@query(
    """SELECT companyid, id, designation, type_name FROM (
    SELECT i.companyid, i.id, i.designation, t.designation AS type_name, row_number() OVER (PARTITION BY i.companyid ORDER BY i.createddate DESC, i.id DESC) AS n
    FROM (SELECT DISTINCT id, companyid, designation, typesid, createddate FROM internaldocs) i JOIN ini_types t ON i.typesid = t.id LEFT JOIN company c ON c.id = i.companyid) WHERE n = 1"""
)
def newest_document(spark, d):
    docs = table(spark, d, "internaldocs").select("id", "companyid", "designation", "typesid", "createddate").distinct()
    types = table(spark, d, "ini_types").select(F.col("id").alias("typesid"), F.col("designation").alias("type_name"))
    company = table(spark, d, "company").select(F.col("id").alias("companyid"))
    newest = Window.partitionBy("companyid").orderBy(F.desc("createddate"), F.desc("id"))
    rows = docs.join(types, "typesid").join(company, "companyid", "left").withColumn("n", F.row_number().over(newest))
    return rows.filter("n = 1").select("companyid", "id", "designation", "type_name")


@query(
    f"""SELECT norm_key, row_number() OVER (PARTITION BY norm_key ORDER BY {_ORDER}, clause_number, title) AS position, clause_number, title
    FROM (SELECT DISTINCT norm_key, clause_number, {_TITLE} AS title FROM iso_clauses WHERE has_requirements = 1)"""
)
def clause_menu(spark, d):
    return registry.clause_menu(table(spark, d, "iso_clauses")).select("norm_key", "position", "clause_number", "title")


@query("SELECT norm_key, count(*) AS clauses, sum(has_requirements)::BIGINT AS requirements FROM (SELECT DISTINCT * FROM iso_clauses) GROUP BY 1")
def clause_counts(spark, d):
    return registry.clause_counts(_clauses(spark, d, "norm_key", "has_requirements"))


# ---------------------------------------------------------------- registry writes
@query("SELECT entry_id, norm_key, generated_at, len(keywords) AS n_keywords FROM keyword_registry QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY generated_at DESC) = 1")
def latest_entries(spark, d):
    rows = table(spark, d, "keyword_registry").select("entry_id", "norm_key", "generated_at", F.when(F.col("keywords").isNotNull(), F.size("keywords").cast("long")).alias("n_keywords"))
    return registry.last_delivery(rows, ["entry_id"], "generated_at")


@query("SELECT DISTINCT clause_uid FROM iso_clauses WHERE norm_key NOT IN (SELECT norm_key FROM iso_norms WHERE norm_version = '')")
def deleted_norms(spark, d):
    gone = table(spark, d, "iso_norms").filter("norm_version = ''")
    return registry.delete_norms(table(spark, d, "iso_clauses"), gone).select("clause_uid").distinct()


@query(
    f"""SELECT clause_uid, norm_id, clause_number FROM {_CLAUSES} WHERE norm_id IN (SELECT norm_id FROM iso_norms WHERE norm_version <> '')
    AND language = 'FR' AND top_level_family IN ('4', '8') AND has_requirements = 1"""
)
def filtered_clauses(spark, d):
    """Binding French clauses of two families, of the norms of a stated version."""
    norms = table(spark, d, "iso_norms").filter("norm_version <> ''").select("norm_id").distinct()
    rows = registry.of_families(_clauses(spark, d), ["4", "8"]).filter("language = 'FR'")
    return rows.join(norms, "norm_id", "left_semi").select("clause_uid", "norm_id", "clause_number")


@query(
    """SELECT norm_key, count(*) AS n, count(*) FILTER (has_requirements = 1) AS requirements FROM (SELECT DISTINCT clause_uid, norm_key, has_requirements FROM iso_clauses
    WHERE norm_key NOT IN (SELECT norm_key FROM iso_norms WHERE language = 'FR') UNION ALL SELECT DISTINCT clause_uid, norm_key, 1 - has_requirements FROM iso_clauses
    WHERE norm_key IN (SELECT norm_key FROM iso_norms WHERE language = 'FR')) GROUP BY 1"""
)
def replaced_norms(spark, d):
    """A second delivery brings the French norms anew, with a changed column."""
    rows = table(spark, d, "iso_clauses").select("clause_uid", "norm_key", "has_requirements").distinct()
    french = table(spark, d, "iso_norms").filter("language = 'FR'").select("norm_key").distinct()
    second = rows.join(french, "norm_key", "left_semi").select("clause_uid", "norm_key", (1 - F.col("has_requirements")).alias("has_requirements"))
    after = registry.write_norms(rows, second, "upsert")
    return after.groupBy("norm_key").agg(F.count("*").alias("n"), F.count_if(F.col("has_requirements") == 1).alias("requirements"))


@query("SELECT doc_id AS id, CASE WHEN lang IS NULL THEN 1 ELSE 2 END AS src FROM documents")
def merged_tables(spark, d):
    """A later delivery holds the documents whose language is known, and wins."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    one, two = docs.select("id", F.lit(1).alias("src")), docs.filter("lang is not null").select("id", F.lit(2).alias("src"))
    return registry.merge_tables(one, two, ["id"], source_wins=True)


@query(
    rf"""WITH v AS (SELECT norm_id || '_' || clause_number || '_part1_p1' AS row_key, {_COUNT.format(T.SHALL)} AS shall,
    {_COUNT.format(T.SHOULD)} AS should, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS n, has_requirements = 1 AS req FROM (SELECT DISTINCT * FROM iso_clauses))
    SELECT row_key, rule, count(*) AS n FROM (SELECT row_key, 'requirement_without_shall' AS rule FROM v WHERE req AND shall <= 0 UNION ALL SELECT row_key, 'too_short' FROM v WHERE n < 3 AND (shall > 0 OR should > 0)
    UNION ALL SELECT row_key, 'chunk_id' FROM v WHERE NOT regexp_full_match(row_key, '[^_]+_[^_]+_part\d+_p\d+')) GROUP BY 1, 2"""
)
def chunk_violations(spark, d):
    """Every rule that a chunk breaks."""
    return registry.violations(_chunks(spark, d)).groupBy("row_key", "rule").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- scalar functions


@query(
    f"""SELECT clause_uid, shall, should, may, can, CASE WHEN shall > 0 THEN 'requirement' WHEN should > 0 THEN 'recommendation' WHEN trim(t) <> '' THEN 'informative' ELSE 'structural' END AS content_type
    FROM (SELECT clause_uid, {_NOTE_FREE} AS t, {_COUNT.format(T.SHALL)} AS shall, {_COUNT.format(T.SHOULD)} AS should, {_COUNT.format(T.MAY)} > 0 AS may, {_COUNT.format(T.CAN)} > 0 AS can FROM {_CLAUSES})"""
)
def modality(spark, d):
    """Counted without notes and examples."""
    shall, should, may, can, kind = T.modality(F.coalesce("text", F.lit("")))
    return _clauses(spark, d, "text").select("clause_uid", shall.cast("long").alias("shall"), should.cast("long").alias("should"), may.alias("may"), can.alias("can"), kind)


@query(
    r"""SELECT clause_uid, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '(?i)(?:see\s+)?(?:clause|section)\s+(\d+(?:\.\d+)*)', 1),
    regexp_extract_all(text, '(?i)(?:voir|r[eé]f[eé]rence\s+en|mentionn[eé]e?s?\s+en|conform[eé]ment\s+(?:aux\s+exigences\s+)?(?:de|[àa]))[\s\x{a0}]+(\d+(?:\.\d+)+)', 1),
    list_transform(regexp_extract_all(text, '(?i)\bISO[\s\x{a0}]+\d{4,5}(?:[-/]\d+)?(?::\d{4})?\b'), lambda x: regexp_replace(x, '[\s\x{a0}]+', ' ', 'g')),
    list_transform(regexp_extract_all(text, '(?i)\bAnnex(?:e)?\s+([A-Z])\b', 1), lambda x: 'Annex ' || x)))), '|') AS refs FROM """
    + _CLAUSES
    + " WHERE text IS NOT NULL"
)
def cross_references(spark, d):
    return _clauses(spark, d, "text").filter("text is not null").select("clause_uid", F.array_join(F.array_sort(T.cross_references("text")), "|").alias("refs"))


@query(f"SELECT clause_uid, {_TITLE} AS title FROM {_CLAUSES}")
def clean_titles(spark, d):
    return _clauses(spark, d, "clause_number", "clause_title").select("clause_uid", T.clean_title("clause_number", "clause_title").alias("title"))


@query(
    rf"""SELECT clause_uid, CASE WHEN trim(coalesce(clause_title, '')) <> '' AND trim(clause_title) <> clause_number THEN trim(clause_title)
    WHEN coalesce(start, '') <> '' THEN start ELSE clause_number END AS title FROM (SELECT *, substr(trim(regexp_replace(text, '[\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')), 1, 80) AS start FROM {_CLAUSES})"""
)
def effective_titles(spark, d):
    return _clauses(spark, d, "clause_number", "clause_title", "text").select("clause_uid", T.effective_title("clause_number", "clause_title", "text").alias("title"))


@query(f"SELECT clause_uid, array_to_string(string_split(clause_number, '.')[:-2], '.') AS parent, string_split(clause_number, '.')[1] AS family FROM {_CLAUSES}")
def clause_parents(spark, d):
    return _clauses(spark, d, "clause_number").select("clause_uid", T.parent_clause("clause_number").alias("parent"), T.clause_family("clause_number").alias("family"))


@query(r"SELECT DISTINCT norm_full, regexp_replace(upper(string_split(norm_full, ':')[1]), '[\s-]', '', 'g') AS norm FROM iso_norms")
def norm_ids(spark, d):
    return table(spark, d, "iso_norms").select("norm_full", T.norm_id("norm_full").alias("norm")).distinct()


@query(
    rf"""SELECT section_uid, n, CASE WHEN n = 0 THEN 0.55 WHEN n < 40 THEN 0.75 WHEN n < 120 THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence FROM (SELECT section_uid, length(trim(coalesce(raw_text, ''))) AS n FROM {_SECTIONS})"""
)
def section_confidence(spark, d):
    rows = _sections(spark, d, "raw_text").select("section_uid", F.length(F.trim(F.coalesce("raw_text", F.lit("")))).cast("long").alias("n"), T.extraction_confidence("raw_text").alias("confidence"))
    return rows


@query(
    r"""SELECT line, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(replace(s, ' ', ''), '[-:]+') OR length(c) < 6 THEN '' ELSE c END AS line FROM (SELECT s, trim(regexp_replace(regexp_replace(s, '\d+', '<num>', 'g'), '\s+', ' ', 'g'), ' -:') AS c
    FROM (SELECT trim(regexp_replace(replace(lower(trim(l)), '|', ' '), '\s+', ' ', 'g')) AS s FROM (SELECT unnest(string_split(replace(markdown, chr(13), ''), chr(10))) AS l FROM (SELECT DISTINCT parsed_id, markdown FROM parsed_documents))))) GROUP BY 1 HAVING count(*) > 1"""
)
def canonical_lines(spark, d):
    lines = table(spark, d, "parsed_documents").select("parsed_id", "markdown").distinct().select(F.explode(F.split(F.replace("markdown", F.lit("\r"), F.lit("")), "\n")).alias("l"))
    return lines.select(T.canonical_line("l").alias("line")).groupBy("line").agg(F.count("*").alias("n")).filter("n > 1")


# ---------------------------------------------------------------- corpus statistics
@query(f"SELECT clause_uid, array_to_string(list_sort(tokens), ' ') AS tokens FROM {_TOKENS}")
def index_tokens(spark, d):
    return _clauses(spark, d, "clause_number", "text").select("clause_uid", F.array_join(F.array_sort(T.index_tokens(F.coalesce("text", F.lit("")), "clause_number")), " ").alias("tokens"))


@query(
    f"""SELECT term, count(DISTINCT clause_uid) AS df, round(ln(((SELECT count(*) FROM {_CLAUSES}) + 1) / (count(DISTINCT clause_uid) + 1)) + 1, 9) AS idf
    FROM (SELECT clause_uid, unnest(terms) AS term FROM {_TERMS}) GROUP BY 1"""
)
def term_idf(spark, d):
    clauses = _clauses(spark, d, "text")
    return corpus.inverse_document_frequency(corpus.term_counts(clauses, "clause_uid"), clauses.count()).withColumn("idf", F.round("idf", 9))


@query(
    f"""WITH c AS (SELECT clause_uid, term, count(*) AS tf FROM (SELECT clause_uid, unnest(terms) AS term FROM {_TERMS}) GROUP BY 1, 2),
    i AS (SELECT term, ln(((SELECT count(*) FROM {_CLAUSES}) + 1) / (count(*) + 1)) + 1 AS idf FROM c GROUP BY 1)
    SELECT clause_uid, rank, term FROM (SELECT clause_uid, term, row_number() OVER (PARTITION BY clause_uid ORDER BY round(tf * idf, 9) DESC, len(string_split(term, ' ')) DESC, term) AS rank FROM c JOIN i USING (term)) WHERE rank <= 5"""
)
def tfidf_keywords(spark, d):
    return corpus.tfidf_keywords(_clauses(spark, d, "text"), "clause_uid").select("clause_uid", "rank", "term")


def _bm25(spark, d):
    return corpus.bm25_vectors(_clauses(spark, d, "clause_number", "text").select("clause_uid", T.index_tokens(F.coalesce("text", F.lit("")), "clause_number").alias("tokens")), "clause_uid")


_BM25 = f"""(WITH c AS (SELECT * FROM {_TOKENS}), s AS (SELECT count(*) AS n, avg(len(tokens)) AS avg FROM c), t AS (SELECT clause_uid, len(tokens) AS len, unnest(tokens) AS token FROM c),
    f AS (SELECT token, count(*) AS df FROM t GROUP BY 1) SELECT clause_uid, {_INDEX} AS idx, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len / avg))) AS weight
    FROM t JOIN f USING (token), s WHERE ln((n - df + 0.5) / (df + 0.5) + 1) > 0 GROUP BY 1, 2)"""


@query(f"SELECT clause_uid, idx, round(weight, 7) AS weight FROM {_BM25}")
def bm25_vectors(spark, d):
    return _bm25(spark, d).select("clause_uid", "idx", F.round("weight", 7).alias("weight"))


@query(
    r"""SELECT DISTINCT doc_id, canonical FROM (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), ' ') || ' ' AS t FROM documents),
    (SELECT DISTINCT lower(k) AS canonical, array_to_string(regexp_extract_all(lower(k), '[\p{L}\p{N}_]+'), ' ') AS form FROM (SELECT unnest(keywords) AS k FROM keyword_registry)) WHERE form <> '' AND contains(t, ' ' || form || ' ')"""
)
def vocabulary_hits(spark, d):
    """All keywords, of any number of words."""
    words = table(spark, d, "keyword_registry").select(F.explode("keywords").alias("form")).distinct().select(F.lower("form").alias("canonical"), "form")
    return corpus.vocabulary_hits(widen(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", words)


# ---------------------------------------------------------------- retrieval
def _dense(spark, d, k=10):
    vectors = table(spark, d, "embeddings")
    return retrieval.dense_top_k(vectors, vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k)


_DENSE = """(SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id,
    round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0))"""


@query(f"SELECT query_id, vec_id, rank, round(score, 6) AS score FROM {_DENSE} WHERE rank <= 10")
def dense_top_k(spark, d):
    return _dense(spark, d).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def _sparse(spark, d, k=20):
    tokens = _clauses(spark, d, "clause_title").filter("clause_uid % 50 = 0").select(F.col("clause_uid").alias("query_id"), T.words(F.coalesce("clause_title", F.lit(""))).alias("tokens"))
    return retrieval.sparse_top_k(_bm25(spark, d), corpus.query_vectors(tokens, "query_id"), k, "clause_uid")


_TITLE_WORDS = _WORDS.replace("coalesce(text, '')", "coalesce(clause_title, '')")
_SPARSE = f"""(SELECT query_id, clause_uid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, clause_uid) AS rank FROM (SELECT query_id, clause_uid, round(sum(q * weight), 9) AS score FROM {_BM25} b
    JOIN (SELECT query_id, {_INDEX} AS idx, count(*)::DOUBLE AS q FROM (SELECT clause_uid AS query_id, unnest({_TITLE_WORDS}) AS token FROM {_CLAUSES} WHERE clause_uid % 50 = 0) GROUP BY 1, 2) q USING (idx) GROUP BY 1, 2))"""


@query(f"SELECT query_id, clause_uid, rank FROM {_SPARSE} WHERE rank <= 20")
def sparse_top_k(spark, d):
    return _sparse(spark, d).select("query_id", "clause_uid", "rank")


@query(
    f"""SELECT query_id, clause_uid, rank, score FROM (SELECT query_id, clause_uid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, clause_uid) AS rank FROM (SELECT query_id, clause_uid, round(sum(1.0 / (60 + rank)), 9) AS score FROM
    (SELECT query_id, clause_uid, rank FROM {_SPARSE} WHERE rank <= 20 UNION ALL SELECT query_id, vec_id, rank FROM {_DENSE} WHERE rank <= 20) GROUP BY 1, 2)) WHERE rank <= 15"""
)
def hybrid_top_k(spark, d):
    dense = _dense(spark, d, 20).withColumnRenamed("vec_id", "clause_uid")
    return retrieval.fuse([_sparse(spark, d), dense], "clause_uid", 15).select("query_id", "clause_uid", "rank", "score")


@query(
    f"""WITH r AS (SELECT query_id, rank, clause_number FROM (SELECT * FROM {_SPARSE} WHERE rank <= 20) JOIN {_CLAUSES} USING (clause_uid)), e AS (SELECT clause_uid AS query_id, string_split(clause_number, '.')[1] AS p FROM {_CLAUSES} WHERE clause_uid % 50 = 0)
    SELECT query_id, first_rank, coalesce(first_rank <= 10, FALSE) AS hit FROM e LEFT JOIN (SELECT query_id, min(rank) AS first_rank FROM r JOIN e USING (query_id) WHERE starts_with(clause_number, p) GROUP BY 1) USING (query_id)"""
)
def hit_rate(spark, d):
    clauses = _clauses(spark, d, "clause_number")
    expected = clauses.filter("clause_uid % 50 = 0").select(F.col("clause_uid").alias("query_id"), F.array(T.clause_family("clause_number")).alias("expected_any"))
    return retrieval.hit_rate(_sparse(spark, d).join(clauses.select("clause_uid", "clause_number"), "clause_uid"), expected)


@query(
    f"""WITH c AS (SELECT query_id, clause_uid, rank, q.w AS qw, {_WORDS} AS tw FROM {_SPARSE} JOIN {_CLAUSES} USING (clause_uid) JOIN (SELECT clause_uid AS query_id, list_distinct({_TITLE_WORDS}) AS w FROM {_CLAUSES} WHERE clause_uid % 50 = 0) q USING (query_id) WHERE rank <= 20)
    SELECT query_id, clause_uid, place FROM (SELECT query_id, clause_uid, row_number() OVER (PARTITION BY query_id ORDER BY round(CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, tw)) / len(qw) ELSE 0 END, 9) DESC, rank, clause_uid) AS place FROM c) WHERE place <= 5"""
)
def reranked(spark, d):
    clauses = _clauses(spark, d, "clause_title", "text")
    asked = clauses.filter("clause_uid % 50 = 0").select(F.col("clause_uid").alias("query_id"), F.coalesce("clause_title", F.lit("")).alias("asked"))
    rows = _sparse(spark, d).join(clauses.select("clause_uid", F.coalesce("text", F.lit("")).alias("text")), "clause_uid").join(asked, "query_id")
    return retrieval.rerank(rows, "clause_uid", retrieval.overlap_score(F.col("asked"), F.col("text")), 5).select("query_id", "clause_uid", "place")


# ---------------------------------------------------------------- segmentation
_PAGES = "(SELECT DISTINCT ON (parsed_id) * FROM parsed_documents)"


def _documents(spark, d):
    return table(spark, d, "parsed_documents").dropDuplicates(["parsed_id"])


_FALSE = r"regexp_matches(trim(h.text), '(?i)^(?:DOCUMENT\s+PROTÉGÉ\s+PAR\s+COPYRIGHT|NORME\s+INTERNATIONALE|ICS\s*[\s\x{2002}]\d+\.\d+|et\b)')"
_SPANS = rf"""(WITH h AS (SELECT parsed_id, length(markdown) AS n, list_filter(heading_positions, lambda h: NOT {_FALSE}) AS hs FROM {_PAGES}), e AS (SELECT parsed_id, n, unnest(hs) AS h, unnest(range(len(hs))) AS pos FROM h)
    SELECT parsed_id, pos, CASE WHEN num <> '' THEN num WHEN annex THEN coalesce(regexp_split_to_array(title, '\s+')[2], 'Annex') ELSE 'H' || (pos + 1) END AS clause_id,
    CASE WHEN num <> '' THEN len(string_split(num, '.')) WHEN annex THEN 1 ELSE level END AS level, start_idx, coalesce(lead(start_idx) OVER (PARTITION BY parsed_id ORDER BY pos), n) AS end_idx
    FROM (SELECT parsed_id, n, pos, trim(h.text) AS title, h.level AS level, h."offset" AS start_idx, regexp_extract(trim(h.text), '^([A-Z]?\d+(?:\.\d+)*)(?:[\s.]|$)', 1) AS num, regexp_matches(trim(h.text), '(?i)^(?:Annexe|Annex|Appendix)\b') AS annex FROM e))"""


@query(f"SELECT parsed_id, pos, clause_id, level, start_idx, end_idx FROM {_SPANS}")
def clause_spans(spark, d):
    return segment.spans(_documents(spark, d)).filter("pos >= 0").select("parsed_id", "pos", "clause_id", "level", "start_idx", "end_idx")


@query(f"SELECT a.parsed_id, a.pos, max(b.pos) AS parent_pos FROM {_SPANS} a LEFT JOIN {_SPANS} b ON a.parsed_id = b.parsed_id AND b.pos < a.pos AND least(b.level, 6) < least(a.level, 6) GROUP BY 1, 2")
def clause_tree(spark, d):
    return segment.parents(segment.spans(_documents(spark, d))).filter("pos >= 0").select("parsed_id", "pos", "parent_pos")


@query(f"SELECT parsed_id, pos, row_number() OVER (PARTITION BY parsed_id, clause_id ORDER BY pos) > 1 AS duplicate FROM {_SPANS}")
def duplicate_clauses(spark, d):
    return segment.duplicates(segment.spans(_documents(spark, d)).filter("pos >= 0")).select("parsed_id", "pos", "duplicate")


@query(
    f"""WITH t AS (SELECT a.parsed_id, a.pos, max(b.pos) AS parent_pos FROM {_SPANS} a LEFT JOIN {_SPANS} b ON a.parsed_id = b.parsed_id AND b.pos < a.pos AND least(b.level, 6) < least(a.level, 6) GROUP BY 1, 2)
    SELECT parsed_id, count(*) AS leaves FROM t WHERE NOT EXISTS (SELECT 1 FROM t p WHERE p.parsed_id = t.parsed_id AND p.parent_pos = t.pos) GROUP BY 1"""
)
def leaf_counts(spark, d):
    return segment.leaf_counts(segment.parents(segment.spans(_documents(spark, d))))


@query(
    f"""SELECT parsed_id, pos, coalesce(CASE WHEN len(k) > 0 THEN page_map[coalesce(list_filter(k, lambda x: x <= start_idx)[-1], k[1])] END, 1) AS page
    FROM (SELECT s.parsed_id, s.pos, s.start_idx, page_map, list_sort(map_keys(page_map)) AS k FROM {_SPANS} s JOIN {_PAGES} USING (parsed_id))"""
)
def page_of_span(spark, d):
    docs = _documents(spark, d)
    return segment.spans(docs).filter("pos >= 0").join(docs.select("parsed_id", "page_map"), "parsed_id").select("parsed_id", "pos", T.page_at("page_map", "start_idx").alias("page"))


@query(
    rf"""WITH l AS (SELECT parsed_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM (SELECT parsed_id, string_split(regexp_replace(markdown, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM {_PAGES} WHERE markdown IS NOT NULL)),
    m AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 1)) AS level FROM l), s AS (SELECT *, sum((level > 0)::INT) OVER (PARTITION BY parsed_id ORDER BY no) AS section_no FROM m),
    g AS (SELECT parsed_id, section_no::BIGINT AS section_no, max(level) AS level, coalesce(max(CASE WHEN level > 0 THEN trim(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 2)) END), '') AS title, coalesce(trim(string_agg(CASE WHEN level = 0 THEN line END, chr(10) ORDER BY no), ' ' || chr(10) || chr(9)), '') AS body FROM s GROUP BY 1, 2)
    SELECT parsed_id, section_no, level, title, length(body) AS chars FROM g WHERE section_no > 0 OR body <> ''"""
)
def markdown_sections(spark, d):
    rows = segment.markdown_sections(_documents(spark, d))
    return rows.select("parsed_id", "section_no", F.col("level").cast("long").alias("level"), "title", F.length("raw_text").cast("long").alias("chars"))


_CONTAINS = lambda col, forms: " OR ".join(f"contains({col}, '" + f.replace("'", "''") + "')" for f in forms)
_TYPE = "CASE " + " ".join(f"WHEN {_CONTAINS('t', f)} THEN '{n}'" for n, f in segment.TITLE_TYPES) + " " + " ".join(f"WHEN {_CONTAINS('b', f)} THEN '{n}'" for n, f in segment.BODY_TYPES) + " ELSE 'procedure_text' END"


@query(f"SELECT section_uid, {_TYPE} AS type FROM (SELECT section_uid, lower(coalesce(title, '')) AS t, lower(coalesce(title, '') || chr(10) || coalesce(raw_text, '')) AS b FROM {_SECTIONS})")
def section_types(spark, d):
    return _sections(spark, d, "title", "raw_text").select("section_uid", segment.section_type(F.coalesce("title", F.lit("")), F.coalesce("raw_text", F.lit(""))).alias("type"))


@query(
    f"""WITH q AS (SELECT doc_id, avg((n = 0)::INT) AS e, avg((n < 40)::INT) AS s, min(coalesce(c, 0)) AS m FROM (SELECT doc_id, length(trim(coalesce(raw_text, ''))) AS n, extraction_confidence AS c FROM {_SECTIONS}) GROUP BY 1),
    r AS (SELECT doc_id, CASE WHEN e >= 0.5 THEN 'C' WHEN s >= 0.25 THEN 'B' ELSE 'A' END AS tier, CASE WHEN e >= 0.5 THEN least(m, 0.5) WHEN s >= 0.25 THEN least(m, 0.8) ELSE greatest(m, 1.0) END::DOUBLE AS min_confidence FROM q)
    SELECT doc_id, tier, min_confidence, tier = 'C' OR min_confidence < 0.65 AS low FROM r"""
)
def document_quality(spark, d):
    return segment.quality(_sections(spark, d, "doc_id", "raw_text", "extraction_confidence"), "doc_id")


@query(f"SELECT doc_id, section_id FROM (SELECT *, trim(coalesce(raw_text, '')) = '' AS blank FROM {_SECTIONS}) QUALIFY NOT blank OR sum(blank::INT) OVER (PARTITION BY doc_id, title) < 2")
def kept_sections(spark, d):
    rows = _sections(spark, d, "doc_id", "section_id", "title", "raw_text").withColumn("raw_text", F.coalesce("raw_text", F.lit("")))
    return segment.drop_repeated_empty(rows, "doc_id").select("doc_id", "section_id")


@query(
    r"""WITH h AS (SELECT DISTINCT lower(trim(clause_title)) AS known FROM iso_clauses WHERE trim(clause_title) <> ''), l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
    m AS (SELECT doc_id, no, line, length(trim(line)) <= 64 AND NOT regexp_matches(trim(line), '[.!?;,]$') AND lower(trim(line)) IN (SELECT known FROM h) AS head FROM l), s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY no) AS section_no FROM m),
    g AS (SELECT doc_id, section_no::BIGINT AS section_no, coalesce(max(CASE WHEN head THEN trim(line) END), '') AS title, coalesce(trim(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY no), ' ' || chr(10) || chr(9)), '') AS body FROM s GROUP BY 1, 2)
    SELECT doc_id, section_no, title, length(body) AS chars FROM g WHERE section_no > 0 OR body <> ''"""
)
def plain_sections(spark, d):
    headings = table(spark, d, "iso_clauses").select(F.col("clause_title").alias("title"))
    rows = segment.plain_sections(widen(table(spark, d, "documents").select("doc_id", "text")), headings, "doc_id", "text")
    return rows.select("doc_id", "section_no", "title", F.length("raw_text").cast("long").alias("chars"))


@query(
    f"""SELECT company_id, doc_id, section_id, row_number() OVER (PARTITION BY company_id, doc_id ORDER BY page_start, section_id) AS position FROM {_SECTIONS} WHERE company_id = 'CMP-0007'"""
)
def tenant_sections(spark, d):
    rows = _sections(spark, d, "company_id", "doc_id", "section_id", "page_start").filter("company_id = 'CMP-0007'")
    order = Window.partitionBy("company_id", "doc_id").orderBy("page_start", "section_id")
    return rows.select("company_id", "doc_id", "section_id", F.row_number().over(order).alias("position"))


@query(f"SELECT norm_key, clause_number, len(tokens) AS token_count FROM {_TOKENS} JOIN {_CLAUSES} USING (clause_uid)")
def token_registry(spark, d):
    tokens = T.index_tokens(F.coalesce("text", F.lit("")), "clause_number")
    return _clauses(spark, d, "norm_key", "clause_number", "text").select("norm_key", "clause_number", F.size(tokens).cast("long").alias("token_count"))


# ---------------------------------------------------------------- layout and streams
@query(
    """WITH b AS (SELECT l_suppkey AS doc, round(l_discount * 100, 1) AS font, sum(l_quantity) AS chars FROM lineitem GROUP BY 1, 2), y AS (SELECT doc, arg_max(font, (chars, font)) AS body, sum(chars) AS total FROM b GROUP BY 1)
    SELECT doc, font, level, body FROM (SELECT doc, font, body, row_number() OVER (PARTITION BY doc ORDER BY font DESC) AS level FROM b JOIN y USING (doc) WHERE font > body + 0.5 AND chars >= greatest(100, total * 0.001)) WHERE level <= 4"""
)
def font_levels(spark, d):
    spans = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_discount") * 100).alias("size"), "l_quantity")
    return layout.font_levels(spans, "l_suppkey", "size", "l_quantity")


@query(
    f"""WITH l AS (SELECT section_uid, company_id AS doc, page_start AS page, unnest(ls) AS line, unnest(range(len(ls))) AS no, len(ls) AS n FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(coalesce(raw_text, ''), '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM {_SECTIONS}))
    SELECT count(*) AS lines, count(DISTINCT section_uid) AS sections FROM l"""
)
def section_lines(spark, d):
    rows = layout.page_lines(_sections(spark, d, "page_start", "raw_text"), "section_uid", "page_start", "raw_text")
    return rows.agg(F.count("*").alias("lines"), F.countDistinct("doc").alias("sections"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark, d):
    from .streaming import windowed_counts

    return windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("SELECT entry_id, generated_at FROM keyword_registry QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY generated_at DESC) = 1")
def streamed_entries(spark, d):
    from .streaming import drain

    schema = table(spark, d, "keyword_registry").schema
    return drain(spark, f"{d}/keyword_registry.parquet", schema, ["entry_id"], "generated_at").select("entry_id", "generated_at")


# ---------------------------------------------------------------- pages
_NAMES = ["ref.", "réf.", "rif.", "issue", "édition", "ausgabe", "edición", "edizione"]


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents)),
    v AS (SELECT doc_id, no, replace(lower(trim(regexp_extract(line, '^([^:\n]{{1,40}}?)\s*:\s*(.*)$', 1))), ' ', '_') AS name, trim(regexp_extract(line, '^([^:\n]{{1,40}}?)\s*:\s*(.*)$', 2)) AS value, lead(line) OVER (PARTITION BY doc_id ORDER BY no) AS nxt FROM l)
    SELECT doc_id, name, arg_max(CASE WHEN value <> '' THEN value ELSE nxt END, no) AS value FROM v WHERE list_contains({_list(_NAMES)}, name) AND (value <> '' OR (NOT contains(nxt, ':') AND length(nxt) <= 120)) GROUP BY 1, 2"""
)
def key_values(spark, d):
    return pages.key_values(widen(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", _NAMES)


@query(
    rf"""WITH l AS (SELECT parsed_id, unnest(string_split(replace(markdown, chr(13), ''), chr(10))) AS line FROM {_PAGES} WHERE markdown IS NOT NULL)
    SELECT parsed_id, line, count(*) AS n FROM l WHERE length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) > 10 AND length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) >= 0.8 * length(regexp_replace(line, '[^\p{{L}}]', '', 'g'))
    AND NOT starts_with(trim(line), '#') AND NOT starts_with(trim(line), '<!--') GROUP BY 1, 2"""
)
def suspect_lines(spark, d):
    lines = _documents(spark, d).filter("markdown is not null").select("parsed_id", F.explode(F.split(F.replace("markdown", F.lit("\r"), F.lit("")), "\n")).alias("line"))
    return pages.suspect_lines(lines).groupBy("parsed_id", "line").agg(F.count("*").alias("n"))


_RUNS = lambda c: rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]+')"


@query(
    f"""SELECT section_uid, round(len(list_filter(e, lambda w: list_contains(t, w))) / nullif(len(e), 0), 6) AS overlap FROM (SELECT section_uid, {_RUNS('title')} AS e, {_RUNS('raw_text')} AS t FROM {_SECTIONS})"""
)
def evidence_overlap(spark, d):
    return _sections(spark, d, "title", "raw_text").select("section_uid", F.round(pages.evidence_overlap(F.col("title"), F.col("raw_text")), 6).alias("overlap"))


#: Ranks and positions that the SQL gives as 64-bit integers.
_LONGS = {
    "clause_menu": ["position"], "tfidf_keywords": ["rank"], "dense_top_k": ["rank"], "sparse_top_k": ["rank"], "hybrid_top_k": ["rank"], "hit_rate": ["first_rank"], "reranked": ["place"], "clause_spans": ["pos", "level", "end_idx"],
    "clause_tree": ["pos", "parent_pos"], "duplicate_clauses": ["pos"], "page_of_span": ["pos"], "tenant_sections": ["position"], "font_levels": ["level"],
}


def _widened(run: Query, names: list[str]) -> Query:
    return lambda spark, d: run(spark, d).withColumns({c: F.col(c).cast("long") for c in names})


def queries() -> dict[str, Query]:
    return {name: _widened(run, _LONGS[name]) if name in _LONGS else run for name, run in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from . import catalog_pages, catalog_text  # noqa: E402, F401  they add their queries to these
