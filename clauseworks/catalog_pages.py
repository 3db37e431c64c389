"""Named queries on pages, layout, ingestion and verdicts, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .catalog import _PAGES, _SECTIONS, _documents, _list, _sections, query
from .functions import text as T
from .operators import hooks, ingest, layout, pages, registry, segment
from .runtime import table, widen

# ---------------------------------------------------------------- text clean-up
_CANON = lambda c: rf"(SELECT CASE WHEN regexp_full_match(replace(s, ' ', ''), '[-:]+') OR length(k) < 6 THEN '' ELSE k END FROM (SELECT s, trim(regexp_replace(regexp_replace(s, '\d+', '<num>', 'g'), '\s+', ' ', 'g'), ' -:') AS k FROM (SELECT trim(regexp_replace(replace(lower(trim({c})), '|', ' '), '\s+', ' ', 'g')) AS s)))"
_MD_LINES = rf"(SELECT parsed_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT parsed_id, string_split(regexp_replace(markdown, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM {_PAGES} WHERE markdown IS NOT NULL))"


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]', '', 'g'), '(?m)^\s*\d+\s*$', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n[ \t]+\n', chr(10) || chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13) || chr(12)) AS text FROM documents WHERE text IS NOT NULL")
def tidy_texts(spark, d):
    """Texts without control characters, lines of page numbers and surplus blanks."""
    rows = widen(table(spark, d, "documents").select("doc_id", "text")).filter("text is not null")
    return rows.select("doc_id", pages.normal_spacing(pages.without_page_numbers(pages.printable(F.col("text")))).alias("text"))


_MARKED = "contains(sample, '|') OR " + " OR ".join(f"contains(lower(sample), '{m}')" for m in pages.MARKERS)


@query(
    rf"""WITH l AS (SELECT *, {_CANON('line')} AS canonical FROM {_MD_LINES}), n AS (SELECT parsed_id FROM l GROUP BY 1 HAVING count(*) >= 6),
    f AS (SELECT parsed_id, canonical FROM (SELECT parsed_id, canonical, count(*) AS n, arg_min(line, pos) AS sample FROM l WHERE canonical <> '' GROUP BY 1, 2) WHERE n >= 2 AND ({_MARKED}) AND parsed_id IN (SELECT parsed_id FROM n)),
    g AS (SELECT l.*, f.canonical IS NOT NULL AS gone FROM l LEFT JOIN f USING (parsed_id, canonical)), b AS (SELECT *, coalesce(lag(gone) OVER w, FALSE) OR coalesce(lead(gone) OVER w, FALSE) AS beside FROM g WINDOW w AS (PARTITION BY parsed_id ORDER BY pos)),
    r AS (SELECT parsed_id, line, CASE WHEN gone THEN 'repeated' WHEN regexp_full_match(regexp_replace(line, '[|\\s]', '', 'g'), '[-:]+') AND beside THEN 'separator' END AS fate FROM b) SELECT parsed_id, fate, trim(line) AS line, count(*) AS n FROM r WHERE fate IS NOT NULL GROUP BY 1, 2, 3"""
)
def removed_lines(spark, d):
    """Header and footer lines that a document of six lines or more repeats, and the rules beside them."""
    lines = pages.text_lines(_documents(spark, d).select("parsed_id", "markdown"), "parsed_id", "markdown")
    gone = pages.repeated_signatures(lines, "parsed_id", least=6).filter("fate is not null")
    return gone.groupBy("parsed_id", "fate", F.trim("line").alias("line")).agg(F.count("*").alias("n"))


@query(
    rf"""WITH l AS (SELECT company_id AS doc, section_uid AS page, unnest(ls) AS line, unnest(range(len(ls))) AS no, len(ls) AS n FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(coalesce(raw_text, ''), '\r?\n'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM {_SECTIONS})),
    c AS (SELECT *, {_CANON('line')} AS canonical FROM l), t AS (SELECT company_id AS doc, count(DISTINCT section_uid) AS total FROM {_SECTIONS} GROUP BY 1),
    e AS (SELECT doc, canonical, max(seen) AS seen FROM (SELECT doc, canonical, count(*) AS seen FROM c WHERE no < 5 AND canonical <> '' GROUP BY 1, 2 UNION ALL SELECT doc, canonical, count(*) FROM c WHERE no >= n - 5 AND canonical <> '' GROUP BY 1, 2) GROUP BY 1, 2)
    SELECT doc, canonical AS line, seen AS pages FROM e JOIN t USING (doc) WHERE seen >= greatest(2, ceil(total * 0.01))"""
)
def repeated_edges(spark, d):
    """Lines at the edges of a hundredth of a company's sections (and two)."""
    return layout.repeated_edges(_sections(spark, d, "company_id", "raw_text"), "company_id", "section_uid", "raw_text", share=0.01)


@query(
    rf"""WITH l AS (SELECT parsed_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT parsed_id, string_split(regexp_replace(markdown, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM {_PAGES} WHERE markdown IS NOT NULL)),
    s AS (SELECT parsed_id, min(pos) AS s FROM l WHERE regexp_matches(line, '^(?:#+\s*)?1\s+[A-Z]') GROUP BY 1), e AS (SELECT l.parsed_id, min(pos) AS e FROM l JOIN s USING (parsed_id) WHERE pos >= s AND regexp_matches(line, '(?i)^(?:#+\s*)?(?:Annexe|Annex|Appendix)\b') GROUP BY 1)
    SELECT parsed_id, CASE WHEN s IS NULL OR pos < s THEN 'front' WHEN pos >= e THEN 'back' ELSE 'clauses' END AS zone, count(*) AS lines FROM l LEFT JOIN s USING (parsed_id) LEFT JOIN e USING (parsed_id) GROUP BY 1, 2"""
)
def document_zones(spark, d):
    lines = pages.text_lines(_documents(spark, d).select("parsed_id", "markdown"), "parsed_id", "markdown")
    return pages.zones(lines, "parsed_id").groupBy("parsed_id", "zone").agg(F.count("*").alias("lines"))


@query("SELECT doc_id, (length(text) - length(replace(text, '...', ''))) // 3 > 10 AS contents FROM documents WHERE text IS NOT NULL")
def contents_pages(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", layout.is_contents_page(F.col("text")).alias("contents"))


# ---------------------------------------------------------------- headings
_HEADS = f"(SELECT parsed_id, standard_id, page_map, unnest(heading_positions) AS h, unnest(range(len(heading_positions))) AS pos FROM {_PAGES})"


def _headings(spark, d):
    rows = _documents(spark, d).select("parsed_id", "standard_id", "page_map", F.posexplode("heading_positions").alias("pos", "h"))
    return rows.select("parsed_id", "standard_id", "page_map", "pos", F.col("h.offset").alias("offset"), F.col("h.level").alias("level"), F.col("h.text").alias("text"))


@query(
    rf"""SELECT parsed_id, pos, 3 * (level <= 2)::INT + 3 * regexp_matches(text, '^[A-Z]?\d+(\.\d+)*[\s.]')::INT + 2 * (level = 1)::INT + (length(text) < 80)::INT
    + (n >= 2 AND l >= 4 AND u / l > 0.7)::INT - ends_with(rtrim(text), '.')::INT AS score FROM (SELECT parsed_id, pos, h.level AS level, h.text AS text, length(regexp_replace(h.text, '[^\p{{L}}]', '', 'g')) AS l, length(regexp_replace(h.text, '[^\p{{Lu}}]', '', 'g')) AS u, len(regexp_extract_all(h.text, '\S+')) AS n FROM {_HEADS})"""
)
def heading_scores(spark, d):
    """Scores of the headings, taking the two upper levels for known fonts and the first for bold and large."""
    one, off = F.col("level") == 1, F.lit(0.0)
    score = pages.heading_score(F.col("text"), F.col("level") <= 2, one, one, off, off, off, off)
    return _headings(spark, d).select("parsed_id", F.col("pos").cast("long").alias("pos"), score.cast("long").alias("score"))


@query(
    rf"""SELECT parsed_id, pos, CASE WHEN NOT list_contains({_list(["Annex", "Annexe", "Références"])}, text) AND text <> '' THEN repeat('#', level) || ' ' || text END AS line FROM (SELECT parsed_id, pos, h.level AS level, h.text AS text FROM {_HEADS})"""
)
def heading_lines(spark, d):
    """Headings as Markdown lines, furniture left out."""
    furniture = F.array(*map(F.lit, ["Annex", "Annexe", "Références"]))
    return _headings(spark, d).select("parsed_id", F.col("pos").cast("long").alias("pos"), layout.block_markdown(F.col("text"), F.col("level"), furniture).alias("line"))


_AT = 'coalesce(CASE WHEN len(k) > 0 THEN page_map[coalesce(list_filter(k, lambda x: x <= h."offset")[-1], k[1])] END, 1)'


@query(f"SELECT DISTINCT parsed_id, trim(regexp_replace(strip_accents(lower(h.text)), '[^a-z0-9]+', ' ', 'g')) AS key, greatest({_AT}, 1) AS page FROM (SELECT *, list_sort(map_keys(page_map)) AS k FROM {_HEADS}) WHERE trim(regexp_replace(strip_accents(lower(h.text)), '[^a-z0-9]+', ' ', 'g')) <> ''")
def heading_keys(spark, d):
    """Headings as comparable keys with their page."""
    items = _headings(spark, d).select("parsed_id", F.lit("section_header").alias("label"), "text", T.page_at("page_map", "offset").alias("page"))
    return pages.page_of_items(items, "parsed_id").distinct()


@query(rf"""SELECT parsed_id, CASE WHEN coalesce(trim(string_split(first, chr(10))[1]), '') <> '' THEN trim(string_split(first, chr(10))[1]) ELSE regexp_replace(string_split(standard_id, '/')[-1], '\.[^.]*$', '') END AS title
    FROM {_PAGES} p LEFT JOIN (SELECT parsed_id, arg_min(h.text, pos) AS first FROM (SELECT *, list_sort(map_keys(page_map)) AS k FROM {_HEADS}) WHERE {_AT} = 1 GROUP BY 1) USING (parsed_id)""")
def document_titles(spark, d):
    """Titles by the first heading of the first page, else by name."""
    first = _headings(spark, d).filter(T.page_at("page_map", "offset") == 1).groupBy("parsed_id").agg(F.min_by("text", "pos").alias("first"))
    return _documents(spark, d).select("parsed_id", "standard_id").join(first, "parsed_id", "left").select("parsed_id", segment.title_of(F.col("first"), F.col("standard_id")).alias("title"))


# ---------------------------------------------------------------- layout
@query(
    """SELECT doc, pos, round(y0 - lag(y1) OVER (PARTITION BY doc ORDER BY pos), 4) AS gap FROM (SELECT l_orderkey AS doc, l_extendedprice AS y0, l_extendedprice + l_quantity AS y1, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey, l_quantity) AS pos FROM lineitem)"""
)
def vertical_gaps(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity")
    blocks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.row_number().over(order).cast("long").alias("pos"), F.col("l_extendedprice").alias("y0"), (F.col("l_extendedprice") + F.col("l_quantity")).alias("y1"))
    return pages.vertical_gaps(blocks).select("doc", "pos", F.round("gap", 4).alias("gap"))


@query(
    """WITH b AS (SELECT l_suppkey AS doc, round(l_discount * 100, 1) AS size, l_tax * 100 AS x0, l_quantity - 5 AS height, l_linenumber AS lines FROM lineitem), y AS (SELECT doc, 5.0 AS body FROM b GROUP BY 1)
    SELECT doc, round(coalesce(avg(x0), 0.0), 6) AS indent, round(coalesce(avg(CASE WHEN height > 0 THEN height / lines END), 12.0), 6) AS spacing FROM y LEFT JOIN (SELECT * FROM b WHERE abs(size - 5.0) <= 0.5) USING (doc) GROUP BY 1"""
)
def layout_means(spark, d):
    blocks = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), F.round(F.col("l_discount") * 100, 1).alias("size"), (F.col("l_tax") * 100).alias("x0"), (F.col("l_quantity") - 5).alias("height"), F.col("l_linenumber").alias("lines"))
    body = blocks.select("doc").distinct().withColumn("body", F.lit(5.0))
    return layout.layout_means(blocks, body, "doc").select("doc", F.round("indent", 6).alias("indent"), F.round("spacing", 6).alias("spacing"))


@query(
    f"""SELECT doc_id, section_uid, s AS page_start, CASE WHEN nxt IS NULL THEN greatest(s, total) ELSE greatest(s, nxt - 1) END AS page_end FROM (SELECT *, lead(s) OVER w AS nxt FROM (SELECT doc_id, section_uid, max(page_start) OVER (PARTITION BY doc_id ORDER BY section_uid) AS s, max(page_end) OVER (PARTITION BY doc_id) AS total FROM {_SECTIONS}) WINDOW w AS (PARTITION BY doc_id ORDER BY section_uid))"""
)
def page_ranges(spark, d):
    """Pages of sections in order: starts never go back, ends reach up to the next start."""
    rows = _sections(spark, d, "doc_id", "page_start", "page_end").withColumn("total", F.max("page_end").over(Window.partitionBy("doc_id"))).withColumnRenamed("page_start", "start")
    return layout.page_ranges(rows.drop("page_end"), "doc_id", "section_uid", "start", "total").select("doc_id", "section_uid", "page_start", "page_end")


# ---------------------------------------------------------------- ingestion
_TIERS = f"""(SELECT *, CASE WHEN e >= 0.5 THEN 'C' WHEN s >= 0.25 THEN 'B' ELSE 'A' END AS tier FROM (SELECT *, avg((n = 0)::INT) OVER w AS e, avg((n < 40)::INT) OVER w AS s FROM (SELECT *, length(trim(coalesce(raw_text, ''))) AS n FROM {_SECTIONS}) WINDOW w AS (PARTITION BY doc_id)))"""


@query(
    f"""SELECT *, CASE WHEN skipped_quality_gate > 0 THEN 'low_quality_document' WHEN ingested = 0 THEN 'no_sections_ingested' END AS reason FROM (SELECT doc_id, count(*) AS total, count(*) FILTER (tier = 'C') AS skipped_quality_gate, count(*) FILTER (tier <> 'C' AND n = 0) AS skipped_empty_text,
    count(*) FILTER (tier <> 'C' AND n > 0 AND coalesce(extraction_confidence, 0) < 0.6) AS skipped_low_confidence, count(*) FILTER (tier <> 'C' AND n > 0 AND coalesce(extraction_confidence, 0) >= 0.6) AS ingested FROM {_TIERS} GROUP BY 1)"""
)
def ingest_counts(spark, d):
    """What the gate lets pass of each document, and why the rest stays out."""
    return ingest.counters(ingest.gated(_sections(spark, d, "doc_id", "raw_text", "extraction_confidence"), "doc_id"), "doc_id")


@query(
    f"""SELECT section_uid, coalesce(section_id, '') AS section_id, CASE WHEN section_type IN {ingest.TYPES} THEN section_type ELSE 'unknown' END AS section_type, coalesce(title, '') AS title, length(coalesce(raw_text, '')) AS chars, coalesce(page_start, 0) AS page_start, coalesce(page_end, page_start, 0) AS page_end,
    coalesce(extraction_confidence, 0.0) AS extraction_confidence, coalesce(heading_level, 1) AS heading_level FROM {_SECTIONS}"""
)
def stored_sections(spark, d):
    """Sections written as payloads and read back with defaults."""
    columns = ("section_id", "section_type", "title", "raw_text", "heading_level", "page_start", "page_end", "extraction_confidence", "doc_id", "company_id", "site_id")
    rows = ingest.section_records(_sections(spark, d, *columns).select("section_uid", ingest.section_payload().alias("payload")))
    return rows.withColumn("chars", F.length("raw_text").cast("long")).drop("raw_text")


@query(
    f"""WITH o AS (SELECT doc_id, count(*) AS n, count(DISTINCT section_id) AS ids, min(extraction_confidence) AS least, count(*) FILTER (section_type <> 'unknown') AS typed, avg((length(trim(coalesce(raw_text, ''))) = 0)::INT) AS e, avg((length(trim(coalesce(raw_text, ''))) < 40)::INT) AS s, min(coalesce(extraction_confidence, 0)) AS m FROM {_SECTIONS} GROUP BY 1),
    q AS (SELECT doc_id, CASE WHEN e >= 0.5 THEN 'C' WHEN s >= 0.25 THEN 'B' ELSE 'A' END AS tier, CASE WHEN e >= 0.5 THEN least(m, 0.5) WHEN s >= 0.25 THEN least(m, 0.8) ELSE greatest(m, 1.0) END::DOUBLE AS mc FROM o),
    d AS (SELECT i.id AS doc_id, tier, mc, lower(regexp_extract(coalesce(filepath, ''), '\\.([^./]+)$', 1)) AS suffix, n, ids, least, typed FROM (SELECT DISTINCT id, filepath FROM internaldocs) i LEFT JOIN o ON o.doc_id = i.id LEFT JOIN q ON q.doc_id = i.id)
    SELECT doc_id, 'empty' AS rule FROM d WHERE n IS NULL UNION ALL SELECT doc_id, 'duplicate_id' FROM d WHERE ids < n UNION ALL SELECT doc_id, 'min_confidence' FROM d WHERE abs(mc - least) > 1e-9 UNION ALL SELECT doc_id, 'suffix' FROM d WHERE suffix <> 'pdf' UNION ALL SELECT doc_id, 'untyped' FROM d WHERE typed = 0"""
)
def broken_documents(spark, d):
    """What the registered documents break of the rules for documents with sections."""
    own = _sections(spark, d, "doc_id", "section_id", "section_type", "raw_text", "extraction_confidence")
    docs = table(spark, d, "internaldocs").select(F.col("id").alias("doc_id"), F.col("filepath").alias("path"), F.lit("pdf").alias("file_format")).distinct()
    return ingest.invariants(own, docs.join(segment.quality(own, "doc_id"), "doc_id", "left"), "doc_id")


_VERDICTS = f"(SELECT section_uid, doc_id, CASE WHEN left_ > 0 THEN llm_valid END AS llm_valid, CASE WHEN left_ > 0 AND llm_valid AND predicted_clause_family IN {ingest.FAMILIES} THEN predicted_clause_family END AS predicted_clause_family, left_ = 0 OR coalesce(llm_valid, TRUE) AS kept FROM (SELECT *, count(*) FILTER (coalesce(llm_valid, TRUE)) OVER (PARTITION BY doc_id) AS left_ FROM {_SECTIONS}))"


@query(f"SELECT section_uid, llm_valid, predicted_clause_family, kept FROM {_VERDICTS}")
def audited_sections(spark, d):
    """Verdicts packed into one noisy answer a document, read back and applied."""
    rows = _sections(spark, d, "doc_id", "section_id", "llm_valid", "predicted_clause_family")
    item = F.struct(F.col("section_id").alias("id"), F.col("llm_valid").alias("valid"), F.col("predicted_clause_family").alias("clause_family"))
    answers = rows.groupBy("doc_id").agg(F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.collect_list(item)), F.lit("\n```")).alias("raw"))
    judged = ingest.verdicts(answers, "doc_id")
    return ingest.audited(rows.select("section_uid", "doc_id", "section_id"), judged, "doc_id").select("section_uid", "llm_valid", "predicted_clause_family", "kept")


@query(f"SELECT section_uid, substr(coalesce(raw_text, ''), 1, 300) AS preview FROM {_SECTIONS}")
def section_previews(spark, d):
    return ingest.previews(_sections(spark, d, "raw_text")).select("section_uid", "preview")


_METRICS = rf"""(SELECT parsed_id, c AS char_count, w AS word_count, p AS pages, h AS heading_count, CASE WHEN p > 0 THEN round(c / p, 1) END AS chars_per_page,
    round(least(1.0, CASE WHEN c > 0 THEN 0.40 ELSE 0 END + CASE WHEN p > 0 THEN 0.15 ELSE 0 END + CASE WHEN trim(coalesce(standard_id, '')) <> '' THEN 0.15 ELSE 0 END + CASE WHEN p > 0 THEN CASE WHEN round(c / p, 1) >= 1000 THEN 0.15 WHEN round(c / p, 1) >= 400 THEN 0.10 WHEN round(c / p, 1) >= 100 THEN 0.05 ELSE 0 END ELSE 0 END
    + CASE WHEN h >= 3 THEN 0.10 WHEN h >= 1 THEN 0.05 ELSE 0 END), 4)::DOUBLE AS accuracy_score, CASE WHEN c = 0 THEN 'empty' END AS error FROM (SELECT parsed_id, standard_id, length(coalesce(markdown, '')) AS c, len(regexp_extract_all(coalesce(markdown, ''), '[^\t-\r \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+')) AS w, len(map_keys(page_map)) AS p, coalesce(len(heading_positions), 0) AS h FROM {_PAGES}))"""


def _metrics(spark, d):
    heads = F.coalesce(F.size(F.filter("heading_positions", lambda x: F.lit(True))), F.lit(0))
    pages_ = F.when(F.col("page_map").isNotNull(), F.size(F.map_keys("page_map")))
    return ingest.parse_metrics(_documents(spark, d), "markdown", pages_, F.col("standard_id"), F.when(heads < 0, 0).otherwise(heads), F.lit(0))


@query(f"SELECT parsed_id, char_count, word_count, pages, heading_count, chars_per_page, accuracy_score FROM {_METRICS}")
def parse_metrics(spark, d):
    long = {c: F.col(c).cast("long") for c in ("char_count", "word_count", "pages", "heading_count")}
    return _metrics(spark, d).select("parsed_id", "char_count", "word_count", "pages", "heading_count", "chars_per_page", "accuracy_score").withColumns(long)


@query(f"SELECT count(*) AS total_files, count(*) FILTER (error IS NULL) AS success, count(*) FILTER (error IS NOT NULL) AS errors, coalesce(round(avg(CASE WHEN error IS NULL THEN accuracy_score END), 4), 0.0) AS avg_accuracy_score FROM {_METRICS}")
def batch_summary(spark, d):
    return ingest.batch_summary(_metrics(spark, d), F.when(F.col("char_count") == 0, "empty"))


@query(f"SELECT doc_id, section_uid FROM (SELECT *, row_number() OVER w AS at, max(CASE WHEN trim(coalesce(raw_text, '')) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_start DESC, section_uid DESC) AS later FROM {_SECTIONS} WINDOW w AS (PARTITION BY doc_id ORDER BY page_start, section_uid)) WHERE later = 1")
def trimmed_sections(spark, d):
    """Sections without the empty ones at a document's end."""
    return segment.trim_trailing(_sections(spark, d, "doc_id", "page_start", "raw_text"), "doc_id", ["page_start", "section_uid"]).select("doc_id", "section_uid")


@query(
    f"""SELECT company_id, n, failed, round(failed / n, 9) AS rate, CASE WHEN failed / n > 0.3 THEN 'critical' WHEN failed / n > 0.1 THEN 'warn' ELSE 'ok' END AS state FROM (SELECT company_id, count(*) AS n, count(*) FILTER (length(trim(coalesce(raw_text, ''))) < 200) AS failed FROM {_SECTIONS} GROUP BY 1)"""
)
def failure_states(spark, d):
    """Share of failures by company against both thresholds; a text of under 200 characters counts as failed here."""
    rows = _sections(spark, d, "company_id", "raw_text")
    failed = F.when(F.length(F.trim(F.coalesce("raw_text", F.lit("")))) < 200, F.lit("short"))
    return hooks.failure_states(rows.withColumn("error", failed), "company_id")


@query(f"SELECT DISTINCT id FROM internaldocs WHERE (id, companyid) NOT IN (SELECT doc_id, company_id FROM {_VERDICTS} JOIN (SELECT section_uid, company_id FROM {_SECTIONS}) USING (section_uid) WHERE kept AND llm_valid AND doc_id IS NOT NULL AND company_id IS NOT NULL)")
def awaiting_documents(spark, d):
    """Registered documents of which no section of the same company has passed an audit."""
    rows = _sections(spark, d, "doc_id", "company_id", "section_id", "llm_valid", "predicted_clause_family")
    judged = rows.filter("llm_valid is not null").select("doc_id", "section_id", "llm_valid", "predicted_clause_family")
    done = ingest.audited(rows.select("section_uid", "doc_id", "company_id", "section_id"), judged, "doc_id").filter("kept and llm_valid").select(F.col("doc_id").alias("id"), F.col("company_id").alias("companyid"))
    return table(spark, d, "internaldocs").select("id", "companyid").join(done, ["id", "companyid"], "left_anti").select("id").distinct()


@query(f"SELECT section_uid, upper(replace(replace(trim('SectionType.' || section_type), '-', '_'), ' ', '_')).split('.')[-1] AS type, 'section_' || CASE WHEN b = '' THEN 'section_' || section_uid ELSE b END || '_' || section_uid AS slug FROM (SELECT section_uid, section_type, trim(regexp_replace(strip_accents(lower(coalesce(title, ''))), '[^a-z0-9]+', '_', 'g'), '_') AS b FROM {_SECTIONS})")
def section_names(spark, d):
    """Type names without an enum's prefix, and ids made of the titles."""
    rows = _sections(spark, d, "section_type", "title")
    return rows.select("section_uid", T.type_name(F.concat(F.lit("SectionType."), "section_type")).alias("type"), T.slug(F.coalesce("title", F.lit("")), F.col("section_uid").cast("string")).alias("slug"))


@query(
    f"""SELECT section_uid, CASE WHEN section_type = 'metadata' AND NOT contains(t, s) THEN trim(t || chr(10) || chr(10) || s, ' ' || chr(10) || chr(9)) ELSE t END AS text FROM (SELECT section_uid, section_type, coalesce(raw_text, '') AS t, 'code: ' || coalesce(section_id, '') || chr(10) || 'site: ' || coalesce(site_id, '') AS s FROM {_SECTIONS})"""
)
def promoted_preambles(spark, d):
    """Metadata sections with their document's fields appended."""
    rows = _sections(spark, d, "section_type", "raw_text", "section_id", "site_id")
    fields = F.create_map(F.lit("code"), F.coalesce("section_id", F.lit("")), F.lit("site"), F.coalesce("site_id", F.lit("")))
    return rows.select("section_uid", segment.promote_fields(F.coalesce("raw_text", F.lit("")), F.col("section_type"), fields).alias("text"))
