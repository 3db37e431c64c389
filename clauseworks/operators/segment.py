"""From marked-up text to spans, a clause hierarchy, chunks and sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

MAX_WORDS = 600
DEEPEST = 6
# Clause numbers and annexes at the start of a heading, and headings that are none.
NUMBER = r"^([A-Z]?\d+(?:\.\d+)*)(?=[\s.]|$)"
ANNEX = r"(?i)^(?:Annexe|Annex|Appendix)\b"
FALSE_HEADING = r"(?i)^(?:DOCUMENT\s+PROTÉGÉ\s+PAR\s+COPYRIGHT|NORME\s+INTERNATIONALE|ICS\s*[\s\x{2002}]\d+\.\d+|et\b)"
# Section types by wording, first in the title, then in title and body.
TITLE_TYPES = (("scope", ("objet", "domaine d'application", "scope")), ("definitions", ("definition", "définition", "glossaire")), ("references", ("référence", "reference", "documents associés")))
BODY_TYPES = (("process_diagram", ("logigramme", "flowchart", "diagram")), ("record_form", ("fiche", "formulaire", "record form")), ("metadata", ("sommaire", "historique", "approbation", "validation")))


def spans(documents: DataFrame, key: str = "parsed_id") -> DataFrame:
    """key, pos, clause_id, level, title, start_idx, end_idx of documents(key, markdown, heading_positions).

    A span ends where the next heading starts; text before the first heading is a preamble (pos -1); a false heading is absorbed
    by the span before it.
    """
    d = documents.select(key, F.length("markdown").alias("n"), "markdown", F.filter("heading_positions", lambda h: ~F.trim(h["text"]).rlike(FALSE_HEADING)).alias("h"))
    heads = d.select(key, "n", F.posexplode("h").alias("pos", "head"))
    order = Window.partitionBy(key).orderBy("pos")
    title = F.trim("head.text")
    number = F.regexp_extract(title, NUMBER, 1)
    annex = title.rlike(ANNEX)
    clause = F.when(number != "", number).when(annex, F.coalesce(F.get(F.split(title, r"\s+"), F.lit(1)), F.lit("Annex"))).otherwise(F.concat(F.lit("H"), (F.col("pos") + 1).cast("string")))
    level = F.when(number != "", F.size(F.split(number, r"\."))).when(annex, 1).otherwise(F.col("head.level"))
    found = heads.select(key, "pos", clause.alias("clause_id"), level.cast("int").alias("level"), title.alias("title"), F.col("head.offset").alias("start_idx"), F.coalesce(F.lead("head.offset").over(order), F.col("n")).alias("end_idx"))
    first = d.select(key, "n", F.coalesce(F.get("h", F.lit(0))["offset"], F.col("n")).alias("first"), "markdown")
    lead = first.filter(F.trim(F.substr("markdown", F.lit(1), F.col("first"))) != "").select(key, F.lit(-1).alias("pos"), F.lit("preamble").alias("clause_id"), F.lit(0).alias("level"), F.lit("").alias("title"), F.lit(0).alias("start_idx"), F.col("first").alias("end_idx"))
    return found.unionByName(lead)


def parents(found: DataFrame, key: str = "parsed_id", deepest: int = DEEPEST) -> DataFrame:
    """Adds parent_pos: the nearest earlier span of a lower level, null at the top; levels above deepest count as deepest."""
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    level = F.least(F.col("level"), F.lit(deepest))
    last = [F.max(F.when((level == k) & (F.col("pos") >= 0), F.col("pos"))).over(order) for k in range(1, deepest)]
    above = [F.when(level > k, x) for k, x in enumerate(last, 1)]
    return found.withColumn("parent_pos", F.when(F.col("pos") >= 0, F.array_max(F.array_compact(F.array(*above)))))


def duplicates(found: DataFrame, key: str = "parsed_id") -> DataFrame:
    """Adds duplicate: a clause id seen before in its document."""
    return found.withColumn("duplicate", F.row_number().over(Window.partitionBy(key, "clause_id").orderBy("pos")) > 1)


def leaf_counts(tree: DataFrame, key: str = "parsed_id") -> DataFrame:
    """key, leaves: spans that are no span's parent."""
    inner = tree.filter("parent_pos is not null").select(key, F.col("parent_pos").alias("pos")).distinct()
    return tree.filter("pos >= 0").join(inner, [key, "pos"], "left_anti").groupBy(key).agg(F.count("*").alias("leaves"))


def pack_paragraphs(text: Column, most: int = MAX_WORDS) -> Column:
    """Parts of at most that many words, cut at blank lines only; a longer paragraph stays whole."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        w = T.word_count(p)
        joined = F.when(acc["now"].isNull(), p).otherwise(F.concat(acc["now"], F.lit("\n\n"), p))
        fits = acc["now"].isNull() | (acc["n"] + w <= most)
        return F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])).alias("done"), F.when(fits, joined).otherwise(p).alias("now"), F.when(fits, acc["n"] + w).otherwise(w).alias("n"))

    paragraphs = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != "")
    packed = F.aggregate(paragraphs, empty, step, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))
    return F.when(T.word_count(text) <= most, F.array(text)).otherwise(packed)


def chunks(clauses: DataFrame, key: str = "clause_uid", most: int = MAX_WORDS) -> DataFrame:
    """key, part, text, words, content_type of clauses(key, text); blank clauses give none."""
    rows = clauses.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select(key, F.posexplode(pack_paragraphs(F.col("text"), most)).alias("part", "text"))
    return rows.select(key, (F.col("part") + 1).alias("part"), "text", T.word_count("text").alias("words"), T.content_type(T.note_free("text")).alias("content_type"))


def section_type(title: Column, body: Column) -> Column:
    """Type by wording: rules on the title first, then on title and body, else procedure text."""
    t, blob = F.lower(title), F.lower(F.concat_ws("\n", title, body))
    out = None
    for rules, where in ((TITLE_TYPES, t), (BODY_TYPES, blob)):
        for name, forms in rules:
            hit = F.lit(False)
            for f in forms:
                hit |= F.contains(where, F.lit(f))
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("procedure_text")


def markdown_sections(documents: DataFrame, key: str = "parsed_id", text: str = "markdown") -> DataFrame:
    """key, section_no, level, title, raw_text: the text split at headings with one to six marks; what stands before is section 0."""
    lines = documents.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("no", "line"))
    head = F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 1)
    running = Window.partitionBy(key).orderBy("no")
    rows = lines.withColumn("level", F.length(head)).withColumn("section_no", F.sum((F.col("level") > 0).cast("int")).over(running))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("no", "line")))), lambda x: x["line"]), "\n")
    out = rows.groupBy(key, "section_no").agg(F.max("level").alias("level"), F.max(F.when(F.col("level") > 0, F.trim(F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 2)))).alias("title"), F.btrim(body, F.lit(" \n\t")).alias("raw_text"))
    return out.filter((F.col("section_no") > 0) | (F.col("raw_text") != "")).select(key, "section_no", "level", F.coalesce("title", F.lit("")).alias("title"), "raw_text")


def plain_sections(documents: DataFrame, headings: DataFrame, key: str, text: str) -> DataFrame:
    """key, section_no, title, raw_text: the text split at lines that are known headings(title), short and without end punctuation; what stands before is section 0."""
    lines = documents.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("no", "line"))
    known = headings.select(F.lower(F.trim("title")).alias("known")).filter("known <> ''").distinct()
    line = F.trim("line")
    marked = lines.withColumn("known", F.when((F.length(line) <= 64) & ~line.rlike(r"[.!?;,]$"), F.lower(line))).join(known.withColumn("is_head", F.lit(1)), "known", "left")
    rows = marked.withColumn("section_no", F.sum(F.coalesce("is_head", F.lit(0))).over(Window.partitionBy(key).orderBy("no")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_head").isNull(), F.struct("no", "line")))), lambda x: x["line"]), "\n")
    out = rows.groupBy(key, "section_no").agg(F.max(F.when(F.col("is_head") == 1, line)).alias("title"), F.btrim(body, F.lit(" \n\t")).alias("raw_text"))
    return out.filter((F.col("section_no") > 0) | (F.col("raw_text") != "")).select(key, "section_no", F.coalesce("title", F.lit("")).alias("title"), "raw_text")


def drop_repeated_empty(sections: DataFrame, key: str) -> DataFrame:
    """Sections without body whose title repeats among such sections are furniture."""
    empty = F.trim("raw_text") == ""
    n = F.sum(empty.cast("int")).over(Window.partitionBy(key, "title"))
    return sections.withColumn("_n", n).filter(~empty | (F.col("_n") < 2)).drop("_n")


def quality(sections: DataFrame, key: str) -> DataFrame:
    """key, tier, min_confidence, low: A, B or C by the shares of empty and short sections."""
    n = F.length(F.trim(F.coalesce("raw_text", F.lit(""))))
    rows = sections.groupBy(key).agg(F.avg((n == 0).cast("int")).alias("empty"), F.avg((n < 40).cast("int")).alias("short"), F.min(F.coalesce("extraction_confidence", F.lit(0.0))).alias("least"))
    tier = F.when(F.col("empty") >= 0.5, "C").when(F.col("short") >= 0.25, "B").otherwise("A")
    least = F.when(F.col("empty") >= 0.5, F.least("least", F.lit(0.5))).when(F.col("short") >= 0.25, F.least("least", F.lit(0.8))).otherwise(F.greatest("least", F.lit(1.0)))
    return rows.select(key, tier.alias("tier"), least.alias("min_confidence"), ((tier == "C") | (least < 0.65)).alias("low"))


def note_free(text: Column) -> Column:
    """The text without NOTE and EXAMPLE blocks, each up to its blank line."""
    return T.note_free(text)


def without_lettered(found: DataFrame) -> DataFrame:
    """Spans without those whose title is a lettered sub-item, which is no clause of its own."""
    return found.filter(~F.col("title").rlike(r"^[a-z][).][ \t]"))


def leaf_bounds(leaves: DataFrame, low: int, high: int) -> DataFrame:
    """leaves with whether their number lies within the bounds that a standard of this kind has."""
    return leaves.withColumn("within", F.col("leaves").between(low, high))


def trim_trailing(sections: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Sections up to the last of each document that has a body."""
    w = Window.partitionBy(key).orderBy(*order)
    body = F.trim(F.coalesce("raw_text", F.lit(""))) != ""
    rows = sections.withColumn("_at", F.row_number().over(w))
    last = F.max(F.when(body, F.col("_at"))).over(Window.partitionBy(key))
    return rows.withColumn("_last", last).filter(F.col("_at") <= F.col("_last")).drop("_at", "_last")


def title_of(first_heading: Column, name: Column) -> Column:
    """Title of a document: its first heading on the first page, else its file's name without folder and suffix."""
    line = F.trim(F.split(first_heading, "\n")[0])
    stem = F.regexp_replace(F.substring_index(name, "/", -1), r"\.[^.]*$", "")
    return F.when(F.coalesce(line, F.lit("")) != "", line).otherwise(stem)


def promote_fields(body: Column, kind: Column, fields: Column) -> Column:
    """A metadata preamble with its key-value lines appended, unless it holds them already."""
    lines = F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    wanted = (kind == "metadata") & (F.coalesce(lines, F.lit("")) != "") & ~F.contains(body, lines)
    return F.when(wanted, F.btrim(F.concat(body, F.lit("\n\n"), lines), F.lit(" \n\t"))).otherwise(body)
