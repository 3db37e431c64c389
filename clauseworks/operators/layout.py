"""Repeated page furniture and font statistics of extracted pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

EDGE_LINES, EDGE_SHARE = 5, 0.6
BOILERPLATE_SHARE, BOILERPLATE_CHARS = 0.3, 500
FONT_GAP, HEADING_CHARS, HEADING_SHARE, LEVELS = 0.5, 100, 0.001, 4


def page_lines(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """doc, page, no, line: the non-blank lines of each page, trimmed, in order."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.posexplode(lines).alias("no", "line"))


def repeated_edges(pages: DataFrame, doc: str, page: str, text: str, probe: int = EDGE_LINES, share: float = EDGE_SHARE) -> DataFrame:
    """doc, line, pages: canonical lines among the first or last probe lines of at least share (and two) of a document's pages."""
    lines = page_lines(pages, doc, page, text)
    size = Window.partitionBy("doc", "page")
    lines = lines.withColumn("n", F.count("*").over(size)).withColumn("canonical", T.canonical_line("line")).filter("canonical <> ''")
    total = pages.groupBy(F.col(doc).alias("doc")).agg(F.countDistinct(page).alias("total"))
    edge = lambda where: lines.filter(where).groupBy("doc", "canonical").agg(F.count("*").alias("seen"))
    top = edge(F.col("no") < probe)
    bottom = edge(F.col("no") >= F.col("n") - probe)
    most = top.unionByName(bottom).groupBy("doc", "canonical").agg(F.max("seen").alias("seen")).join(total, "doc")
    return most.filter(F.col("seen") >= F.greatest(F.lit(2), F.ceil(F.col("total") * F.lit(share)))).select("doc", F.col("canonical").alias("line"), F.col("seen").alias("pages"))


def boilerplate(blocks: DataFrame, share: float = BOILERPLATE_SHARE, longest: int = BOILERPLATE_CHARS) -> DataFrame:
    """doc, text of blocks(doc, page, zone, text) that stand in one zone on more than share of the pages; each single-line block counts as block and as line."""
    pages = blocks.groupBy("doc").agg(F.countDistinct("page").alias("total"))
    short = blocks.filter((F.length("text") < longest) & (F.trim("text") != "") & F.col("zone").isNotNull())
    units = F.concat(F.array(F.trim("text")), F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    counts = short.select("doc", "zone", F.explode(units).alias("text")).groupBy("doc", "zone", "text").agg(F.count("*").alias("seen"))
    return counts.join(pages, "doc").filter(F.col("seen") > F.col("total") * F.lit(share)).select("doc", "text").distinct()


def font_levels(spans: DataFrame, doc: str, size: str, chars: str) -> DataFrame:
    """doc, font, level, body: heading fonts clearly above the body font (the one with most characters), the four largest as levels."""
    by = spans.groupBy(F.col(doc).alias("doc"), F.round(size, 1).alias("font")).agg(F.sum(chars).alias("chars"))
    body = by.groupBy("doc").agg(F.max_by("font", F.struct("chars", "font")).alias("body"), F.sum("chars").alias("total"))
    large = by.join(body, "doc").filter((F.col("font") > F.col("body") + FONT_GAP) & (F.col("chars") >= F.greatest(F.lit(float(HEADING_CHARS)), F.col("total") * HEADING_SHARE)))
    level = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("font")))
    return large.withColumn("level", level).filter(F.col("level") <= LEVELS).select("doc", "font", "level", "body")


def table_markdown(cells):
    """Rows of cells as a Markdown table: nulls blank, line breaks spaces, a rule after the first row."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))), " | "), F.lit(" |"))
    rule = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.lit("---")), " | "), F.lit(" |"))
    rows = F.transform(cells, row)
    return F.when(F.size(cells) > 0, F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule(F.get(cells, F.lit(0)))), F.slice(rows, 2, 1_000_000)), "\n")).otherwise("")


def is_contents_page(text):
    """A page with more than ten leaders of three dots."""
    return F.size(F.split(text, r"\.\.\.")) - 1 > 10


def page_ranges(starts: DataFrame, doc: str, order: str, start: str, total: str) -> DataFrame:
    """Adds page_start (running maximum) and page_end (before the next start, at least the start; the last ends with the document)."""
    w = Window.partitionBy(doc).orderBy(order)
    first = starts.withColumn("page_start", F.max(start).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nxt = F.lead("page_start").over(w)
    return first.withColumn("page_end", F.when(nxt.isNull(), F.greatest("page_start", total)).otherwise(F.greatest(F.col("page_start"), nxt - 1)))


NO_INDENT, LINE_SPACING = 0.0, 12.0


def block_text(lines):
    """Text of a block from its lines of spans: spans joined, control characters out, line ends trimmed, lines kept apart."""
    line = lambda spans: F.rtrim(F.regexp_replace(F.array_join(F.transform(spans, lambda s: s["text"]), ""), r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]", ""))
    return F.btrim(F.array_join(F.transform(lines, line), "\n"), F.lit(" \n\t"))


def dominant_size(lines):
    """Largest font size of a block's spans that hold text, 0 without any."""
    sizes = F.transform(F.filter(F.flatten(lines), lambda s: F.trim(s["text"]) != ""), lambda s: s["size"])
    return F.round(F.coalesce(F.array_max(sizes), F.lit(0.0)), 1)


def layout_means(blocks: DataFrame, body: DataFrame, doc: str, gap: float = FONT_GAP) -> DataFrame:
    """doc, indent, spacing: means over the blocks(doc, size, x0, height, lines) in body size (body: doc, body); 0 and 12 where there are none."""
    rows = blocks.join(body, doc).filter(F.abs(F.col("size") - F.col("body")) <= gap)
    means = rows.groupBy(doc).agg(F.avg("x0").alias("indent"), F.avg(F.when(F.col("height") > 0, F.col("height") / F.col("lines"))).alias("spacing"))
    return body.select(doc).join(means, doc, "left").select(doc, F.coalesce("indent", F.lit(NO_INDENT)).alias("indent"), F.coalesce("spacing", F.lit(LINE_SPACING)).alias("spacing"))


def block_markdown(text, level, furniture):
    """Markdown of a block: null when furniture(array) or empty; furniture lines and page numbers beside them out; headings with their marks."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    some = F.exists(lines, lambda x: F.array_contains(furniture, x))
    left = F.filter(lines, lambda x: ~F.array_contains(furniture, x) & ~x.rlike(r"^[ivxlcdmIVXLCDM\d]+$"))
    body = F.when(some, F.array_join(left, "\n")).otherwise(text)
    marked = F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), body)).otherwise(body)
    return F.when((F.coalesce(text, F.lit("")) != "") & ~F.array_contains(furniture, text) & (body != ""), marked)
