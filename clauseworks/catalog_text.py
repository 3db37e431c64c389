"""Named queries on clauses, vocabulary, registry rows and retrieval, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .catalog import _BM25, _CLAUSES, _COUNT, _FALSE, _ORDER, _PAGES, _SPANS, _SPARSE, _WORDS, _clauses, _documents, _list, _NOTE_FREE, _sparse, _TITLE, query
from .functions import text as T
from .operators import corpus, registry, retrieval, segment
from .runtime import table

_BLANKS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_N_WORDS = lambda c: f"len(regexp_extract_all({c}, '[^{_BLANKS}]+'))"
_RUNS = lambda c: rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]+')"
_PADDED = lambda c: f"' ' || array_to_string({_RUNS(c)}, ' ') || ' '"

# ---------------------------------------------------------------- chunks
_PACKED = rf"""(SELECT clause_uid, unnest(parts) AS text, unnest(range(1, len(parts) + 1)) AS part, len(parts) AS parts FROM (SELECT clause_uid, CASE WHEN {_N_WORDS('text')} <= 600 THEN [text] ELSE list_append(p.done, p.now) END AS parts FROM (
    SELECT clause_uid, text, list_reduce(list_transform(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x) <> ''), lambda x: {{'done': []::VARCHAR[], 'now': x, 'n': {_N_WORDS('x')}}}),
    lambda a, b: CASE WHEN a.n + b.n <= 600 THEN {{'done': a.done, 'now': a.now || chr(10) || chr(10) || b.now, 'n': a.n + b.n}} ELSE {{'done': list_append(a.done, a.now), 'now': b.now, 'n': b.n}} END) AS p FROM {_CLAUSES} WHERE trim(coalesce(text, '')) <> '')))"""
_KIND = "CASE WHEN shall > 0 THEN 'requirement' WHEN should > 0 THEN 'recommendation' WHEN trim(t) <> '' THEN 'informative' ELSE 'structural' END"
_MODAL = lambda source: f"(SELECT *, {_NOTE_FREE} AS t, {_COUNT.format(T.SHALL)} AS shall, {_COUNT.format(T.SHOULD)} AS should, {_COUNT.format(T.MAY)} > 0 AS may, {_COUNT.format(T.CAN)} > 0 AS can FROM {source})"


def _parts(spark, d):
    """Chunks of all clauses with how many their clause has."""
    rows = segment.chunks(_clauses(spark, d, "text"))
    return rows.withColumn("parts", F.count("*").over(Window.partitionBy("clause_uid")))


@query(f"SELECT clause_uid, part, {_N_WORDS('text')} AS words, {_KIND} AS content_type FROM {_MODAL(_PACKED)}")
def packed_chunks(spark, d):
    return segment.chunks(_clauses(spark, d, "text")).select("clause_uid", F.col("part").cast("long").alias("part"), F.col("words").cast("long").alias("words"), "content_type")


_REFS = r"""list_concat(regexp_extract_all(text, '(?i)(?:see\s+)?(?:clause|section)\s+(\d+(?:\.\d+)*)', 1),
    regexp_extract_all(text, '(?i)(?:voir|r[eé]f[eé]rence\s+en|mentionn[eé]e?s?\s+en|conform[eé]ment\s+(?:aux\s+exigences\s+)?(?:de|[àa]))[\s\x{a0}]+(\d+(?:\.\d+)+)', 1),
    list_transform(regexp_extract_all(text, '(?i)\bISO[\s\x{a0}]+\d{4,5}(?:[-/]\d+)?(?::\d{4})?\b'), lambda x: regexp_replace(x, '[\s\x{a0}]+', ' ', 'g')),
    list_transform(regexp_extract_all(text, '(?i)\bAnnex(?:e)?\s+([A-Z])\b', 1), lambda x: 'Annex ' || x))"""
_ENTRIES = "(SELECT entry_id, keywords FROM keyword_registry QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY generated_at DESC) = 1)"


def _entries(spark, d):
    rows = table(spark, d, "keyword_registry").select("entry_id", "generated_at", "keywords")
    return registry.last_delivery(rows, ["entry_id"], "generated_at").select(F.col("entry_id").alias("clause_uid"), "keywords")


@query(
    f"""SELECT norm_id || '_' || clause_number || '_part' || part || '_p1' AS chunk_id, norm_id, clause_number, string_split(clause_number, '.')[1] AS clause_family, array_to_string(string_split(clause_number, '.')[:-2], '.') AS parent_clause, part AS chunk_index, parts AS total_chunks,
    {_N_WORDS('text')} AS token_count, {_KIND} AS content_type, shall AS shall_count, should AS should_count, shall > 0 AS has_requirements, may AS has_permissions, should > 0 AS has_recommendations, can AS has_capabilities, coalesce(array_to_string(keywords, ','), '') AS keywords,
    len(list_distinct({_REFS})) AS n_related, clause_uid FROM {_MODAL(f"(SELECT p.*, c.norm_id, c.clause_number, k.keywords FROM {_PACKED} p JOIN (SELECT clause_uid, norm_id, clause_number FROM {_CLAUSES}) c USING (clause_uid) LEFT JOIN {_ENTRIES} k ON k.entry_id = p.clause_uid)")}"""
)
def chunk_records(spark, d):
    """The registry and payload columns of every chunk."""
    rows = _parts(spark, d).join(_clauses(spark, d, "norm_id", "clause_number"), "clause_uid").join(_entries(spark, d), "clause_uid", "left").withColumn("page", F.lit(1))
    out = registry.chunk_records(rows, "clause_uid")
    longs = {c: F.col(c).cast("long") for c in ("chunk_index", "total_chunks", "token_count", "shall_count", "should_count")}
    related = F.when(F.col("related_clauses") == "", 0).otherwise(F.size(F.split("related_clauses", ","))).cast("long")
    return out.withColumns(longs).withColumn("n_related", related).drop("page_number", "related_clauses")


@query(
    f"""SELECT clause_uid, CASE WHEN shall > 0 AND items > 0 THEN items ELSE shall END AS obligations FROM (SELECT clause_uid, {_COUNT.format(T.SHALL)} AS shall, len(regexp_extract_all({_NOTE_FREE}, '(?m)^\\s*[a-z]\\)\\s')) AS items FROM {_CLAUSES})"""
)
def obligations(spark, d):
    return _clauses(spark, d, "text").select("clause_uid", T.obligations(F.coalesce("text", F.lit(""))).cast("long").alias("obligations"))


@query(f"SELECT clause_uid, {_KIND} AS content_type FROM {_MODAL(_CLAUSES)} WHERE {_KIND} IN ('requirement', 'recommendation')")
def eligible_clauses(spark, d):
    """Clauses of the content types that are embedded."""
    return _clauses(spark, d, "text").select("clause_uid", T.content_type(T.note_free(F.coalesce("text", F.lit("")))).alias("content_type")).filter(F.col("content_type").isin("requirement", "recommendation"))


# ---------------------------------------------------------------- vocabulary and queries
_HITS = lambda low, terms: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({low}, '\\b{t}\\b') THEN '{t}' END" for t in terms) + "], lambda x: x IS NOT NULL)"
_MODAL_HITS = lambda c: rf"list_sort(list_distinct(list_concat(CASE WHEN language = 'FR' THEN {_HITS(f'lower({c})', T.MODAL_FR)} ELSE {_HITS(f'lower({c})', T.MODAL_EN)} END, regexp_extract_all({c}, '\b\d+\.\d+(?:\.\d+)*\b'))))"


@query(f"SELECT clause_uid, array_to_string({_MODAL_HITS('t')}, '|') AS hits FROM (SELECT clause_uid, language, coalesce(text, '') AS t FROM {_CLAUSES})")
def modal_terms(spark, d):
    return _clauses(spark, d, "language", "text").select("clause_uid", F.array_join(T.modal_terms(F.coalesce("text", F.lit("")), "language"), "|").alias("hits"))


_VOCABULARY = "(SELECT lower(k) AS canonical, norm_id AS standard, k AS form FROM (SELECT norm_id, unnest(keywords) AS k FROM keyword_registry))"


def _vocabulary(spark, d):
    """The keywords as vocabulary: an entry is tagged with the norms that list it."""
    rows = table(spark, d, "keyword_registry").select("norm_id", F.explode("keywords").alias("form")).distinct()
    return rows.groupBy(F.lower("form").alias("canonical"), "form").agg(F.collect_set("norm_id").alias("standards"))


_SCOPED = f"""(SELECT DISTINCT q.clause_uid, v.canonical FROM (SELECT clause_uid, norm_id, {_PADDED('text')} AS t FROM {_CLAUSES}) q JOIN (SELECT DISTINCT canonical, standard, array_to_string({_RUNS('form')}, ' ') AS form FROM {_VOCABULARY}) v ON v.standard = q.norm_id AND v.form <> '' AND contains(q.t, ' ' || v.form || ' '))"""


@query(f"SELECT clause_uid, canonical FROM (SELECT DISTINCT h.clause_uid, h.canonical FROM (SELECT q.clause_uid, q.norm_id, v.canonical FROM (SELECT clause_uid, norm_id, {_PADDED('clause_title')} AS t FROM {_CLAUSES}) q JOIN (SELECT DISTINCT canonical, array_to_string({_RUNS('form')}, ' ') AS form FROM {_VOCABULARY}) v ON v.form <> '' AND contains(q.t, ' ' || v.form || ' ')) h JOIN {_VOCABULARY} s ON s.canonical = h.canonical AND s.standard = h.norm_id)")
def scoped_titles(spark, d):
    """Vocabulary entries in the titles of clauses, only those that the clause's norm lists."""
    rows = _clauses(spark, d, "norm_id", "clause_title").withColumn("scope", F.array("norm_id"))
    return corpus.scoped_hits(rows, "clause_uid", "clause_title", _vocabulary(spark, d), "scope")


_ASKED = f"(SELECT clause_uid AS query_id, coalesce(clause_title, '') AS query, language, norm_id, parent_clause FROM {_CLAUSES} WHERE clause_uid % 50 = 0)"
_TITLE_TOKENS = _WORDS.replace("coalesce(text, '')", "query")


@query(
    rf"""WITH h AS (SELECT query_id, list(DISTINCT x.canonical) AS found FROM (SELECT q.query_id, q.norm_id, v.canonical FROM (SELECT *, {_PADDED('query')} AS t FROM {_ASKED}) q JOIN (SELECT DISTINCT canonical, array_to_string({_RUNS('form')}, ' ') AS form FROM {_VOCABULARY}) v ON v.form <> '' AND contains(q.t, ' ' || v.form || ' ')) x
    JOIN {_VOCABULARY} s ON s.canonical = x.canonical AND s.standard = x.norm_id GROUP BY 1), a AS (SELECT q.*, list_sort(list_distinct(list_concat(coalesce(found, []::VARCHAR[]), {_MODAL_HITS('query')}))) AS hits FROM {_ASKED} q LEFT JOIN h USING (query_id)),
    b AS (SELECT *, list_concat(hits, CASE WHEN coalesce(parent_clause, '') <> '' THEN [parent_clause] ELSE []::VARCHAR[] END) AS every, list_concat({_TITLE_TOKENS}, list_filter(string_split(regexp_replace(coalesce(regexp_extract(query, '\b\d+\.\d+(?:\.\d+)*\b'), ''), '[^0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS base FROM a)
    SELECT query_id, 'search_query: ' || query AS embed_text, array_to_string(hits, '|') AS hits, array_to_string(list_sort(list_distinct(list_concat(base, flatten(list_transform(list_filter(every, lambda x: regexp_full_match(x, '\d+\.\d+(\.\d+)*')), lambda x: string_split(x, '.'))),
    list_filter(flatten(list_transform(list_filter(every, lambda x: NOT regexp_full_match(x, '\d+\.\d+(\.\d+)*')), lambda x: regexp_split_to_array(lower(x), '\s+'))), lambda w: w <> '')))), ' ') AS tokens FROM b"""
)
def transformed_queries(spark, d):
    """The titles of every fiftieth clause as queries on their norm, with the parent clause asked for."""
    rows = _clauses(spark, d, "clause_title", "language", "norm_id", "parent_clause").filter("clause_uid % 50 = 0")
    parent = F.when(F.coalesce("parent_clause", F.lit("")) != "", F.array("parent_clause"))
    asked = rows.select(F.col("clause_uid").alias("query_id"), F.coalesce("clause_title", F.lit("")).alias("query"), "language", F.array("norm_id").alias("norms"), parent.alias("specific"))
    out = retrieval.transform_queries(asked, _vocabulary(spark, d))
    return out.select("query_id", "embed_text", F.array_join("hits", "|").alias("hits"), F.array_join("tokens", " ").alias("tokens"))


@query(
    rf"""SELECT clause_uid, array_to_string(list_sort(list_distinct(list_concat(w, n, list_filter(regexp_split_to_array(lower(array_to_string(coalesce(keywords, []::VARCHAR[]), ' ') || ' ' || coalesce(hits, '')), '\s+'), lambda x: x <> '')))), ' ') AS tokens FROM
    (SELECT clause_uid, {_WORDS} AS w, list_filter(string_split(regexp_replace(clause_number, '[^0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS n FROM {_CLAUSES}) LEFT JOIN (SELECT entry_id AS clause_uid, keywords FROM {_ENTRIES}) USING (clause_uid)
    LEFT JOIN (SELECT clause_uid, string_agg(canonical, ' ') AS hits FROM {_SCOPED} GROUP BY 1) USING (clause_uid)"""
)
def enriched_tokens(spark, d):
    """Index tokens with the words of the clause's keywords and of the vocabulary its norm lists."""
    rows = _clauses(spark, d, "norm_id", "clause_number", "text").withColumn("scope", F.array("norm_id"))
    hits = corpus.scoped_hits(rows, "clause_uid", "text", _vocabulary(spark, d), "scope").groupBy("clause_uid").agg(F.collect_set("canonical").alias("hits"))
    both = rows.join(_entries(spark, d), "clause_uid", "left").join(hits, "clause_uid", "left")
    none = F.array().cast("array<string>")
    both = both.withColumn("bonus", F.concat(F.coalesce("keywords", none), F.coalesce("hits", none)))
    return both.select("clause_uid", F.array_join(F.array_sort(T.index_tokens(F.coalesce("text", F.lit("")), "clause_number", "bonus")), " ").alias("tokens"))


@query(f"SELECT clause_uid, array_to_string(list(idx ORDER BY idx), ' ') AS indices FROM {_BM25} GROUP BY 1")
def sorted_vectors(spark, d):
    from .catalog import _bm25

    return corpus.sorted_vectors(_bm25(spark, d), "clause_uid").select("clause_uid", F.array_join(F.transform("indices", lambda i: i.cast("string")), " ").alias("indices"))


@query(
    f"""WITH r AS (SELECT query_id, rank, clause_number FROM (SELECT * FROM {_SPARSE} WHERE rank <= 20) JOIN {_CLAUSES} USING (clause_uid)), e AS (SELECT clause_uid AS query_id, string_split(clause_number, '.')[1] AS p FROM {_CLAUSES} WHERE clause_uid % 50 = 0),
    h AS (SELECT query_id, p, coalesce(first_rank <= 10, FALSE)::INT AS hit FROM e LEFT JOIN (SELECT query_id, min(rank) AS first_rank FROM r JOIN e USING (query_id) WHERE starts_with(clause_number, p) GROUP BY 1) USING (query_id))
    SELECT tier, count(*) AS queries, sum(hit)::BIGINT AS hits, round(avg(hit), 9) AS rate FROM (SELECT p AS tier, hit FROM h UNION ALL SELECT 'all', hit FROM h) GROUP BY 1"""
)
def hit_rates(spark, d):
    """Share of queries with an expected clause among the best ten, by the clause's family and over all."""
    clauses = _clauses(spark, d, "clause_number")
    asked = clauses.filter("clause_uid % 50 = 0").select(F.col("clause_uid").alias("query_id"), T.clause_family("clause_number").alias("tier"))
    hits = retrieval.hit_rate(_sparse(spark, d).join(clauses, "clause_uid"), asked.select("query_id", F.array("tier").alias("expected_any")))
    return retrieval.hit_rates(hits, asked)


# ---------------------------------------------------------------- registry rows
@query(f"SELECT clause_uid FROM {_CLAUSES} WHERE clause_number IN (SELECT clause_number FROM iso_clauses WHERE has_requirements = 1 AND top_level_family = '8' AND trim(clause_number) <> '')")
def fetched_clauses(spark, d):
    """Clauses by their numbers: those that bind somewhere in family 8."""
    asked = table(spark, d, "iso_clauses").filter("has_requirements = 1 and top_level_family = '8'").select("clause_number")
    return registry.fetch(_clauses(spark, d, "clause_number"), asked).select("clause_uid")


@query(
    f"""SELECT norm_key, clause_number, max(has_requirements) AS has_requirements, array_to_string(list(coalesce(text, '') ORDER BY clause_uid::VARCHAR), chr(10) || chr(10)) AS text, coalesce(list(clause_title ORDER BY clause_uid::VARCHAR)[1], '') AS title
    FROM (SELECT * FROM {_CLAUSES}) GROUP BY 1, 2"""
)
def merged_parts(spark, d):
    """Clauses of their parts, each clause row being a part."""
    rows = _clauses(spark, d, "norm_key", "clause_number", "clause_title", "text", "has_requirements")
    parts = rows.select("norm_key", "clause_number", F.lit(1).alias("chunk_index"), F.lit(1).alias("page"), F.col("clause_uid").cast("string").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("clause_title", F.lit("")).alias("title"), "has_requirements")
    return registry.merge_parts(parts)


@query(
    f"""SELECT clause_uid, l AS language, v AS norm_version, f AS top_level_family, norm_id || ':' || v || ':' || l AS norm_key FROM (SELECT clause_uid, norm_id, coalesce(nullif(trim(language), ''), 'EN') AS l, coalesce(norm_version, '') AS v,
    coalesce(nullif(trim(CASE WHEN has_requirements = 1 THEN top_level_family END), ''), string_split(clause_number, '.')[1]) AS f FROM {_CLAUSES})"""
)
def migrated_clauses(spark, d):
    """Rows of the older single table (here: without a family unless they bind) under the keyed schema."""
    rows = _clauses(spark, d, "norm_id", "norm_version", "language", "clause_number", "top_level_family", "has_requirements")
    old = rows.withColumn("top_level_family", F.when(F.col("has_requirements") == 1, F.col("top_level_family")))
    return registry.migrate_legacy(old).select("clause_uid", "language", "norm_version", "top_level_family", "norm_key")


@query(
    f"""SELECT norm_key, clause_number, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
    FROM (SELECT DISTINCT norm_key, clause_number, sha1(from_hex('{T.DNS}') || encode(norm_key || ':' || clause_number)) AS h FROM iso_clauses)"""
)
def point_ids(spark, d):
    rows = table(spark, d, "iso_clauses").select("norm_key", "clause_number").distinct()
    return rows.withColumn("point_id", T.uuid5(F.concat_ws(":", "norm_key", "clause_number")))


@query(f"SELECT norm_key, array_to_string(list(clause_number || ' ' || title ORDER BY position), ' | ') AS menu FROM (SELECT norm_key, clause_number, title, row_number() OVER (PARTITION BY norm_key ORDER BY {_ORDER}, clause_number, title) AS position FROM (SELECT DISTINCT norm_key, clause_number, {_TITLE} AS title FROM iso_clauses WHERE has_requirements = 1)) GROUP BY 1")
def norm_menus(spark, d):
    rows = registry.menus(registry.clause_menu(table(spark, d, "iso_clauses")))
    return rows.select("norm_key", F.array_join(F.transform("clauses", lambda c: F.concat_ws(" ", c["clause_number"], c["title"])), " | ").alias("menu"))


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT record_uid FROM term_probes)")
def looked_up(spark, d):
    """Points by id."""
    return registry.lookup(table(spark, d, "embeddings").select("vec_id"), table(spark, d, "term_probes").select(F.col("record_uid").alias("vec_id")), "vec_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT record_uid FROM term_probes WHERE record_uid IS NOT NULL)")
def remaining_points(spark, d):
    """Points without those of some ids."""
    return registry.delete_points(table(spark, d, "embeddings").select("vec_id"), table(spark, d, "term_probes").select(F.col("record_uid").alias("vec_id")), "vec_id")


@query("SELECT DISTINCT parsed_id, coalesce(norm_id, upper(standard_id)) AS norm_id, coalesce(norm_version, '') AS norm_version FROM parsed_documents LEFT JOIN (SELECT norm_full, min(norm_id) AS norm_id, min(norm_version) AS norm_version FROM iso_norms GROUP BY 1) ON norm_full = standard_id")
def norm_labels(spark, d):
    return registry.norm_labels(table(spark, d, "parsed_documents").select("parsed_id", "standard_id").distinct(), table(spark, d, "iso_norms")).select("parsed_id", "norm_id", "norm_version")


@query("SELECT i.id, c.name AS company, t.designation AS type_name FROM (SELECT DISTINCT id, companyid, typesid FROM internaldocs) i JOIN ini_types t ON t.id = i.typesid LEFT JOIN company c ON c.id = i.companyid AND c.companygroupid IS NOT NULL")
def company_documents(spark, d):
    """Documents with their type and, where it belongs to a group, their company."""
    docs = table(spark, d, "internaldocs").select("id", "companyid", "typesid").distinct()
    types = table(spark, d, "ini_types").select(F.col("id").alias("typesid"), F.col("designation").alias("type_name"))
    grouped = table(spark, d, "company").filter("companygroupid is not null").select(F.col("id").alias("companyid"), F.col("name").alias("company"))
    return docs.join(F.broadcast(types), "typesid").join(grouped, "companyid", "left").select("id", "company", "type_name")


# ---------------------------------------------------------------- spans
@query(
    rf"""SELECT parsed_id, pos, clause_id, level, start_idx, end_idx FROM {_SPANS} UNION ALL SELECT parsed_id, -1, 'preamble', 0, 0, first FROM (SELECT parsed_id, markdown, coalesce(hs[1]."offset", length(markdown)) AS first FROM
    (SELECT parsed_id, markdown, list_filter(heading_positions, lambda h: NOT {_FALSE}) AS hs FROM {_PAGES})) WHERE trim(substr(markdown, 1, first)) <> ''"""
)
def all_spans(spark, d):
    """Spans with the preamble before the first heading."""
    rows = segment.spans(_documents(spark, d))
    return rows.select("parsed_id", F.col("pos").cast("long").alias("pos"), "clause_id", F.col("level").cast("long").alias("level"), "start_idx", F.col("end_idx").cast("long").alias("end_idx"))


@query(
    f"""WITH s AS (SELECT * FROM {_SPANS} JOIN (SELECT parsed_id, unnest(range(len(hs))) AS pos, trim(unnest(hs).text) AS title FROM (SELECT parsed_id, list_filter(heading_positions, lambda h: NOT {_FALSE}) AS hs FROM {_PAGES})) USING (parsed_id, pos) WHERE NOT regexp_matches(title, '^[a-z][).][ \\t]')),
    t AS (SELECT a.parsed_id, a.pos, max(b.pos) AS parent_pos FROM s a LEFT JOIN s b ON a.parsed_id = b.parsed_id AND b.pos < a.pos AND least(b.level, 6) < least(a.level, 6) GROUP BY 1, 2),
    l AS (SELECT parsed_id, count(*) AS leaves FROM t WHERE NOT EXISTS (SELECT 1 FROM t p WHERE p.parsed_id = t.parsed_id AND p.parent_pos = t.pos) GROUP BY 1) SELECT parsed_id, leaves, leaves BETWEEN 3 AND 75 AS within FROM l"""
)
def leaf_bounds(spark, d):
    """Leaf clauses of each document without lettered items, and whether their number is plausible."""
    tree = segment.parents(segment.without_lettered(segment.spans(_documents(spark, d))))
    return segment.leaf_bounds(segment.leaf_counts(tree), 3, 75)
