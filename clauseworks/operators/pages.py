"""Pages and headings of extracted documents: edge cuts, page ranges of titles, heading scores and repair, zones, key-value lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

PROBE, SHARE = 5, 0.6
# Signals of a heading and their weights (font known, numbered, bold and larger, wide gap, short, left, capitals, ends with a period).
FONT, NUMBERED, BOLD, GAP, BRIEF, LEFT, CAPITALS, PERIOD = 3, 3, 2, 2, 1, 1, 1, -1
SHORT_TEXT, CAPITAL_SHARE, GAP_TIMES, THRESHOLD, THRESHOLD_PLAIN = 80, 0.7, 1.5, 4, 6
SECTION = r"^[A-Z]?\d+(\.\d+)*[\s.]"


def edge_cuts(pages: DataFrame, probe: int = PROBE, share: float = SHARE) -> DataFrame:
    """doc, page, lines, top, bottom of pages(doc, page, text): how many lines at each edge repeat on share (and two) of the document's pages.

    The longest repeated block of lines wins, else the run of repeated single lines. Edges are small arrays; only their canonical
    forms are shuffled.
    """
    clean = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = pages.select("doc", "page", clean.alias("lines")).withColumn("n", F.size("lines"))
    canon = lambda a: F.transform(a, T.canonical_line)
    head = canon(F.slice("lines", 1, probe))
    tail = F.reverse(canon(F.when(F.col("n") > probe, F.slice("lines", -probe, probe)).otherwise(F.col("lines"))))
    rows = rows.withColumn("edges", F.array(F.struct(F.lit("top").alias("edge"), head.alias("canon")), F.struct(F.lit("bottom").alias("edge"), tail.alias("canon"))))
    long = rows.select("doc", "page", F.inline("edges"))
    need = pages.groupBy("doc").agg(F.greatest(F.lit(2), F.ceil(F.count("*") * F.lit(share))).alias("need"))
    sizes = F.when(F.size("canon") >= 1, F.sequence(F.lit(1), F.size("canon"))).otherwise(F.array().cast("array<int>"))
    blocks = long.select("doc", "edge", F.explode(F.filter(F.transform(sizes, lambda k: F.slice("canon", F.lit(1), k)), lambda b: F.forall(b, lambda x: x != "") & (F.size(b) >= 2))).alias("block"))
    single = long.select("doc", "edge", F.explode(F.filter("canon", lambda x: x != "")).alias("line"))
    often = lambda df, by: df.groupBy("doc", "edge", by).agg(F.count("*").alias("seen")).join(need, "doc").filter("seen >= need").groupBy("doc", "edge").agg(F.collect_set(by).alias(f"{by}s"))
    known = long.join(often(blocks, "block"), ["doc", "edge"], "left").join(often(single, "line"), ["doc", "edge"], "left")
    fits = F.filter(F.coalesce("blocks", F.array().cast("array<array<string>>")), lambda b: F.slice("canon", F.lit(1), F.size(b)) == b)
    longest = F.coalesce(F.array_max(F.transform(fits, lambda b: F.size(b))), F.lit(0))
    lines = F.coalesce("lines", F.array().cast("array<string>"))
    stop = F.array_position(F.transform("canon", lambda x: (x != "") & F.array_contains(lines, x)), False)
    run = F.when(stop == 0, F.size("canon")).otherwise(stop - 1)
    cuts = known.withColumn("cut", F.when(longest > 0, longest).otherwise(run).cast("int")).groupBy("doc", "page").pivot("edge", ["top", "bottom"]).agg(F.first("cut"))
    return rows.select("doc", "page", "lines", "n").join(cuts, ["doc", "page"]).select("doc", "page", "lines", "top", F.least("bottom", F.col("n") - F.col("top")).alias("bottom"))


def cut_edges(cuts: DataFrame) -> DataFrame:
    """doc, page, text without its repeated edges."""
    keep = F.slice("lines", F.col("top") + 1, F.greatest(F.lit(0), F.size("lines") - F.col("top") - F.col("bottom")))
    return cuts.select("doc", "page", F.array_join(keep, "\n").alias("text"))


def title_pages(sections: DataFrame, pages: DataFrame, total: str = "total") -> DataFrame:
    """Adds page_start of sections(doc, pos, title, total): the first page, from the last hit on, that holds the title; never going back.

    pages(doc, page_texts) has one array of page texts a document.
    """
    key = lambda c: F.trim(F.regexp_replace(T.fold(c), r"[^a-z0-9]+", " "))
    one = sections.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", key("title").alias("key")))).alias("s")).join(pages.select("doc", F.transform("page_texts", key).alias("p")), "doc")
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<pos:int,page:int>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        left = F.slice("p", acc["at"], F.greatest(F.size("p") - acc["at"] + 1, F.lit(0)))
        hit = F.array_position(F.transform(left, lambda x: F.contains(x, s["key"])), True).cast("int")
        page = F.when((s["key"] != "") & (s["key"] != "preamble") & (hit > 0), acc["at"] + hit - 1).otherwise(acc["at"])
        return F.struct(page.alias("at"), F.array_append(acc["out"], F.struct(s["pos"].cast("int").alias("pos"), page.alias("page"))).alias("out"))

    found = one.select("doc", F.inline(F.aggregate("s", start, step, lambda acc: acc["out"])))
    return sections.join(found.withColumnRenamed("page", "page_start"), ["doc", "pos"])


def heading_score(text: Column, font_known: Column, bold: Column, larger: Column, gap: Column, spacing: Column, indent: Column, body_indent: Column) -> Column:
    """Weighted sum of eight signals that a block is a heading."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    on = lambda cond, weight: F.when(F.coalesce(cond, F.lit(False)), weight).otherwise(0)
    return (
        on(font_known, FONT) + on(text.rlike(SECTION), NUMBERED) + on(bold & larger, BOLD) + on((spacing > 0) & (gap > spacing * GAP_TIMES), GAP) + on(F.length(text) < SHORT_TEXT, BRIEF)
        + on((body_indent > 0) & (indent < body_indent), LEFT) + on((T.word_count(text) >= 2) & (letters >= 4) & (capitals / F.nullif(letters, F.lit(0)) > CAPITAL_SHARE), CAPITALS) + on(F.rtrim(text).endswith("."), PERIOD)
    )


def heading_level(text: Column, font_level: Column, bold: Column, larger: Column) -> Column:
    """Depth from the font table, else from number and weight, annexes at 2; 0 for body text."""
    depth = F.size(F.split(text, r"\.")) - 1
    numbered, annex = text.rlike(SECTION), text.rlike(r"(?i)^(?:Annexe|Annex|Appendix)\b")
    return F.when(F.coalesce(font_level, F.lit(0)) > 0, font_level).when(larger & bold, F.least(F.lit(4), F.when(numbered, depth).otherwise(0) + 2)).when(numbered & larger, F.least(F.lit(4), depth + 1)).when(annex, 2).otherwise(0)


def vertical_gaps(blocks: DataFrame) -> DataFrame:
    """Adds gap: distance of y0 to the former block's y1 on its page, null for the first."""
    return blocks.withColumn("gap", F.col("y0") - F.lag("y1").over(Window.partitionBy("doc", "page").orderBy("pos")))


def repair_headings(lines: DataFrame, key: str = "doc") -> DataFrame:
    """key, pos, line of lines(key, pos, line): clause numbers inside body lines become headings, bare numbers take the title that follows."""
    inline = r"(?s)^(\d+(?:\.\d+)+)[ \t\n]+(.+)"
    two = F.regexp_replace("line", r"^(#[^\n]*)\n\s*(\S(?:(?![.:]\s*$)[^\n]){0,118}(?<![.:]))\s*$", "$1 $2")
    number = F.regexp_extract("line", inline, 1)
    marks = F.repeat(F.lit("#"), F.least(F.lit(4), F.size(F.split(number, r"\."))))
    parts = F.when(~F.startswith("line", F.lit("#")) & (number != ""), F.array(F.concat(marks, F.lit(" "), number), F.trim(F.regexp_extract("line", inline, 2)))).otherwise(F.array("line"))
    split = lines.withColumn("line", two).select(key, "pos", F.posexplode(parts).alias("part", "line")).filter("line <> ''")
    order = Window.partitionBy(key).orderBy("pos", "part")
    bare = F.col("line").rlike(r"^#{1,4} \d+(?:\.\d+)*$")
    nxt = F.lead("line").over(order)
    title = ~F.startswith(nxt, F.lit("#")) & ~nxt.rlike(r"^\d+(?:\.\d+)+") & (F.length(nxt) < 120) & ~F.rtrim(nxt).endswith(".")
    rows = split.withColumn("takes", F.coalesce(bare & title, F.lit(False))).withColumn("next", nxt)
    rows = rows.withColumn("taken", F.coalesce(F.lag("takes").over(order), F.lit(False)))
    out = rows.filter(~F.col("taken")).select(key, "pos", "part", F.when(F.col("takes"), F.concat_ws(" ", "line", "next")).otherwise(F.col("line")).alias("line"))
    return out.withColumn("pos", F.row_number().over(order)).select(key, "pos", "line")


def clause_zone(lines: DataFrame, key: str = "doc") -> DataFrame:
    """Lines from the first normative clause (1 and a capital) up to the first annex after it."""
    start = lines.filter(F.col("line").rlike(r"^(?:#+\s*)?1\s+[A-Z]")).groupBy(key).agg(F.min("pos").alias("start"))
    rows = lines.join(start, key).filter("pos >= start")
    end = rows.filter(F.col("line").rlike(r"(?i)^(?:#+\s*)?(?:Annexe|Annex|Appendix)\b")).groupBy(key).agg(F.min("pos").alias("end"))
    return rows.join(end, key, "left").filter(F.col("end").isNull() | (F.col("pos") < F.col("end"))).select(key, "pos", "line")


def suspect_lines(lines: DataFrame) -> DataFrame:
    """Lines that may be missed headings: more than ten letters, at least four fifths of them capitals; marked lines aside."""
    letters, capitals = F.length(F.regexp_replace("line", r"[^\p{L}]", "")), F.length(F.regexp_replace("line", r"[^\p{Lu}]", ""))
    return lines.filter((letters > 10) & (capitals >= 0.8 * letters) & ~F.startswith(F.trim("line"), F.lit("#")) & ~F.startswith(F.trim("line"), F.lit("<!--")))


def key_values(texts: DataFrame, key: str, column: str, allowed: list[str]) -> DataFrame:
    """key, name, value: lines "Name : value" with an allowed name, the last of each name; a bare "Name :" takes the next line."""
    lines = texts.select(key, F.posexplode(F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("no", "line"))
    name = F.replace(F.lower(F.trim(F.regexp_extract("line", r"^([^:\n]{1,40}?)\s*:\s*(.*)$", 1))), F.lit(" "), F.lit("_"))
    value = F.trim(F.regexp_extract("line", r"^([^:\n]{1,40}?)\s*:\s*(.*)$", 2))
    nxt = F.lead("line").over(Window.partitionBy(key).orderBy("no"))
    taken = F.when(value != "", value).when(~F.contains(nxt, F.lit(":")) & (F.length(nxt) <= 120), nxt)
    rows = lines.select(key, "no", name.alias("name"), taken.alias("value")).filter(F.col("name").isin(allowed) & F.col("value").isNotNull())
    return rows.groupBy(key, "name").agg(F.max_by("value", "no").alias("value"))


def evidence_overlap(evidence: Column, text: Column) -> Column:
    """Share of the evidence's words that the text holds, each use counted; null without words."""
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    own = F.array_distinct(words(text))
    e = words(evidence)
    return F.size(F.filter(e, lambda w: F.array_contains(own, w))) / F.nullif(F.size(e), F.lit(0))


def json_array(raw: Column, schema: str) -> Column:
    """The JSON array in a noisy answer: as it stands, without code fences, or the first bracketed part; null where none parses."""
    t = F.trim(raw)
    tries = [t, F.regexp_replace(t, r"(?s)^```(?:json)?\s*|\s*```$", ""), F.regexp_extract(t, r"(?s)\[.*\]", 0)]
    parsed = [F.when(F.startswith(F.trim(x), F.lit("[")), F.from_json(x, f"array<{schema}>")) for x in tries]
    return F.coalesce(*parsed)


# Words that mark a repeated line as header or footer.
MARKERS = ("edition", "indice", "code", "page:", "page ", "footer", "header")
REPEATS, LEAST_LINES = 2, 20


def text_lines(texts: DataFrame, key: str, column: str) -> DataFrame:
    """key, pos, line: every line of a text, line ends of all kinds."""
    return texts.filter(F.col(column).isNotNull()).select(key, F.posexplode(F.split(F.regexp_replace(column, "\r\n?", "\n"), "\n")).alias("pos", "line"))


def repeated_signatures(lines: DataFrame, key: str, repeats: int = REPEATS, least: int = LEAST_LINES) -> DataFrame:
    """lines with fate: repeated (a header or footer line that its document of at least so many lines repeats), separator (rules beside one), else null."""
    marked = lines.withColumn("canonical", T.canonical_line("line"))
    first = marked.filter("canonical <> ''").groupBy(key, "canonical").agg(F.count("*").alias("n"), F.min_by("line", "pos").alias("sample"))
    sign = F.contains("sample", F.lit("|"))
    for m in MARKERS:
        sign |= F.contains(F.lower("sample"), F.lit(m))
    size = lines.groupBy(key).agg(F.count("*").alias("lines")).filter(F.col("lines") >= least).select(key)
    known = first.filter((F.col("n") >= repeats) & sign).join(size, key, "left_semi").select(key, "canonical", F.lit(True).alias("gone"))
    rows = marked.join(known, [key, "canonical"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    order = Window.partitionBy(key).orderBy("pos")
    beside = F.coalesce(F.lag("gone").over(order), F.lit(False)) | F.coalesce(F.lead("gone").over(order), F.lit(False))
    # the bars' class holds a backslash and the letter s as well
    rule = F.regexp_replace("line", r"[|\\s]", "").rlike(r"^[-:]+$")
    return rows.withColumn("beside", beside).select(key, "pos", "line", F.when(F.col("gone"), "repeated").when(rule & F.col("beside"), "separator").alias("fate"))


def normal_spacing(text: Column | str) -> Column:
    """Without blanks at line ends and lines of blanks, at most one empty line in a row, trimmed."""
    t = F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n[ \t]+\n", "\n\n")
    return F.btrim(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit(" \n\t\r\f"))


def printable(text: Column | str) -> Column:
    """Without control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]", "")


def without_page_numbers(text: Column | str) -> Column:
    """Without lines of digits only; the blank lines around such a line go with it."""
    return F.regexp_replace(text, r"(?m)^\s*\d+\s*$", "")


def zones(lines: DataFrame, key: str = "doc") -> DataFrame:
    """lines with zone: front (up to the first normative clause; all of a text without one), clauses, back (from the first annex after that on)."""
    start = lines.filter(F.col("line").rlike(r"^(?:#+\s*)?1\s+[A-Z]")).groupBy(key).agg(F.min("pos").alias("_start"))
    rows = lines.join(start, key, "left")
    end = rows.filter((F.col("pos") >= F.col("_start")) & F.col("line").rlike(r"(?i)^(?:#+\s*)?(?:Annexe|Annex|Appendix)\b")).groupBy(key).agg(F.min("pos").alias("_end"))
    zone = F.when(F.col("_start").isNull() | (F.col("pos") < F.col("_start")), "front").when(F.col("pos") >= F.col("_end"), "back").otherwise("clauses")
    return rows.join(end, key, "left").withColumn("zone", zone).drop("_start", "_end")


def heading_items(items: DataFrame) -> DataFrame:
    """Items(label, text, ...) that are headings: by label, or numbered like one."""
    label = F.upper(F.coalesce("label", F.lit("")))
    return items.filter(label.rlike("SECTION_HEADER|TITLE|HEADING") | F.trim("text").rlike(r"^\d+(\.\d+)*[.)]?\s+\S"))


def page_of_items(items: DataFrame, doc: str) -> DataFrame:
    """doc, key, page: heading items as comparable keys with their first page, at least 1."""
    key = F.trim(F.regexp_replace(T.fold("text"), r"[^a-z0-9]+", " "))
    return heading_items(items).select(doc, key.alias("key"), F.greatest(F.coalesce("page", F.lit(1)), F.lit(1)).alias("page")).filter("key <> ''")
