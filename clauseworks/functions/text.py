"""Text expressions on columns: all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modal wording, by weight.
SHALL = "shall|must|is required to|are required to|doit|doivent"
SHOULD = "should|il convient|it is recommended|devrait|devraient"
MAY = "may|peut|peuvent"
CAN = "can"

# Modal terms of the vocabulary scan, by language.
MODAL_EN = ["shall", "must", "is required to", "should", "it is recommended", "may", "is permitted", "can"]
MODAL_FR = ["doit", "doivent", "est tenu de", "il convient", "peut", "peuvent", "est permis", "il est possible de"]
CLAUSE = r"\b\d+\.\d+(?:\.\d+)*\b"
# How a note, an example and a lettered item begin.
NOTE = r"(?i)\n[^\S\n]*(?:NOTE|EXAMPLE)[^\n]*(?:\n[^\n]*\S[^\n]*)*"
LETTERED = r"(?m)^\s*[a-z]\)\s"

# Stop words of the term extractor.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is are was were be been being have has had do does did will"
    " would could should may might shall must can this that these those it its not no nor so yet both either neither each all any"
    " their there they them then than when where which who what how if while also more such into out up about after before between through"
    " la le les de du des un une en et ou si il ils elle elles ce se sa son ses au aux par sur sous dans dont que qui est sont doit doivent"
    " leur leurs tout tous toute toutes cette cet ces mais car donc voir"
).split()

# Patterns of cross references, in the order in which they are listed.
REF_CLAUSE_EN = r"(?i)(?:see\s+)?(?:clause|section)\s+(\d+(?:\.\d+)*)"
REF_CLAUSE_FR = r"(?i)(?:voir|r[eé]f[eé]rence\s+en|mentionn[eé]e?s?\s+en|conform[eé]ment\s+(?:aux\s+exigences\s+)?(?:de|[àa]))[\s\x{a0}]+(\d+(?:\.\d+)+)"
REF_ISO = r"(?i)\bISO[\s\x{a0}]+\d{4,5}(?:[-/]\d+)?(?::\d{4})?\b"
REF_ANNEX = r"(?i)\bAnnex(?:e)?\s+([A-Z])\b"

# Fixed value: marks that the tokenizer drops.
MARKUP = r"(?s)#+\s|<!--.*?-->|\*\*|\*|`|\[.*?\]"
SPARSE_DIMENSION = 1 << 17
#: Name space of deterministic ids (RFC 4122, DNS).
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: Column | str) -> Column:
    """Words of at least three letters (ASCII and Latin-1) without markup and stop words, in order."""
    runs = F.regexp_extract_all(F.lower(F.regexp_replace(_c(text), MARKUP, " ")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(runs, lambda w: w.rlike("^[a-zà-ÿ]{3,}$") & ~w.isin(STOP_WORDS))


def terms(text: Column | str) -> Column:
    """Words, then the pairs of neighbouring words."""
    return with_pairs(words(text))


def with_pairs(w: Column) -> Column:
    """An array of words, then the pairs of its neighbours; the array should be a column by then, as it is used several times."""
    n = F.size(w)
    pairs = F.when(n > 1, F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def index_tokens(text: Column | str, clause: Column | str | None = None, bonus: Column | str | None = None, dedup: bool = True) -> Column:
    """Tokens for lexical search: words, the digits of a clause number, the single words of bonus phrases."""
    parts = [words(text)]
    if clause is not None:
        parts.append(F.filter(F.split(F.regexp_replace(_c(clause), r"[^0-9]+", " "), " "), lambda x: x != ""))
    if bonus is not None:
        parts.append(F.filter(F.split(F.lower(F.array_join(_c(bonus), " ")), r"\s+"), lambda x: x != ""))
    tokens = F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])
    return F.array_distinct(tokens) if dedup else tokens


def token_index(token: Column | str) -> Column:
    """Place of a token in the sparse vector: its md5 as a number modulo the dimension."""
    return F.conv(F.right(F.md5(_c(token)), F.lit(5)), 16, 10).cast("int").bitwiseAND(F.lit(SPARSE_DIMENSION - 1))


def modal_count(text: Column | str, forms: str) -> Column:
    return F.size(F.regexp_extract_all(_c(text), F.lit(rf"(?i)\b({forms})\b"), F.lit(0)))


def note_free(text: Column | str) -> Column:
    """The text without NOTE and EXAMPLE blocks, each from its line up to the next blank one, which stays."""
    return F.regexp_replace(F.regexp_replace(F.concat(F.lit("\n"), _c(text)), NOTE, ""), r"^\n", "")


def content_type(text: Column | str) -> Column:
    """Of a text without notes: requirement over recommendation over informative; structural when blank."""
    t = _c(text)
    return F.when(t.rlike(rf"(?i)\b({SHALL})\b"), "requirement").when(t.rlike(rf"(?i)\b({SHOULD})\b"), "recommendation").when(F.trim(t) != "", "informative").otherwise("structural")


def modality(text: Column | str) -> list[Column]:
    """shall_count, should_count, has_permissions, has_capabilities, content_type, counted without notes and examples."""
    t = note_free(text)
    return [modal_count(t, SHALL).alias("shall_count"), modal_count(t, SHOULD).alias("should_count"), t.rlike(rf"(?i)\b({MAY})\b").alias("has_permissions"), t.rlike(rf"(?i)\b({CAN})\b").alias("has_capabilities"), content_type(t).alias("content_type")]


def obligations(text: Column | str) -> Column:
    """Discrete obligations: the lettered items of a text that binds, else its binding words."""
    t = note_free(text)
    items, bound = F.size(F.regexp_extract_all(t, F.lit(LETTERED), F.lit(0))), modal_count(t, SHALL)
    return F.when((bound > 0) & (items > 0), items).otherwise(bound)


def modal_terms(text: Column | str, language: Column | str) -> Column:
    """Modal terms of the language (French for FR, else English) and clause numbers in the text, sorted."""
    low = F.lower(_c(text))
    find = lambda terms: F.array_compact(F.array(*[F.when(low.rlike(rf"\b{t}\b"), F.lit(t)) for t in terms]))
    modal = F.when(_c(language) == "FR", find(MODAL_FR)).otherwise(find(MODAL_EN))
    return F.array_sort(F.array_distinct(F.concat(modal, F.regexp_extract_all(_c(text), F.lit(CLAUSE), F.lit(0)))))


def cross_references(text: Column | str) -> Column:
    """Distinct references in the order clause (English), clause (French), ISO documents, annexes."""
    t = _c(text)
    iso = F.transform(F.regexp_extract_all(t, F.lit(REF_ISO), F.lit(0)), lambda x: F.regexp_replace(x, r"[\s\x{a0}]+", " "))
    annex = F.transform(F.regexp_extract_all(t, F.lit(REF_ANNEX), F.lit(1)), lambda x: F.concat(F.lit("Annex "), x))
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(REF_CLAUSE_EN), F.lit(1)), F.regexp_extract_all(t, F.lit(REF_CLAUSE_FR), F.lit(1)), iso, annex))


def word_count(text: Column | str) -> Column:
    """White-space separated words, Unicode white space included."""
    return F.size(F.regexp_extract_all(_c(text), F.lit(r"(?U)\S+"), F.lit(0)))


def collapse(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def clean_title(number: Column | str, title: Column | str, longest: int = 80) -> Column:
    """Title without leading marks, tabs and its own number; cut with dots when too long; the number when nothing is left."""
    n = _c(number)
    t = F.trim(F.replace(F.regexp_replace(F.coalesce(_c(title), F.lit("")), r"^#+\s*", ""), F.lit("\t"), F.lit(" ")))
    t = F.when(F.startswith(t, n), F.btrim(F.substr(t, F.length(n) + 1), F.lit(" .:-"))).otherwise(t)
    t = F.when(F.length(t) > longest, F.concat(F.substring(t, 1, longest - 3), F.lit("..."))).otherwise(t)
    return F.when(t == "", n).otherwise(t)


def effective_title(number: Column | str, title: Column | str, text: Column | str) -> Column:
    """The title, unless blank or only the number: then the start of the text, then the number."""
    t = F.trim(F.coalesce(_c(title), F.lit("")))
    start = F.substring(collapse(text), 1, 80)
    return F.when((t != "") & (t != _c(number)), t).when(F.coalesce(start, F.lit("")) != "", start).otherwise(_c(number))


def parent_clause(number: Column | str) -> Column:
    p = F.split(_c(number), r"\.")
    return F.array_join(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), ".")


def clause_family(number: Column | str) -> Column:
    return F.substring_index(_c(number), ".", 1)


def clause_order(number: Column | str) -> Column:
    """Sort key: the leading integer of each dotted part, 0 where there is none."""
    return F.transform(F.split(_c(number), r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^(\d+)", 1).try_cast("int"), F.lit(0)))


def norm_id(label: Column | str) -> Column:
    return F.regexp_replace(F.upper(F.substring_index(_c(label), ":", 1)), r"[\s-]", "")


def canonical_line(line: Column | str) -> Column:
    """A line as it repeats from page to page: lower case, bars and spaces collapsed, numbers masked; blank when too short or only rules."""
    s = F.trim(F.regexp_replace(F.replace(F.lower(F.trim(_c(line))), F.lit("|"), F.lit(" ")), r"\s+", " "))
    rules = F.replace(s, F.lit(" "), F.lit("")).rlike("^[-:]+$")
    s = F.btrim(F.regexp_replace(F.regexp_replace(s, r"\d+", "<num>"), r"\s+", " "), F.lit(" -:"))
    return F.when(rules | (F.length(s) < 6), "").otherwise(s)


def fold(text: Column | str) -> Column:
    """ASCII skeleton of Latin text: lower case, accents off."""
    accents, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    return F.translate(F.lower(_c(text)), accents, plain)


def slug(title: Column | str, index: Column | int) -> Column:
    """section_ + title in letters and digits + _ + index; a title without any is section_ + index again."""
    body = F.btrim(F.regexp_replace(fold(title), r"[^a-z0-9]+", "_"), F.lit("_"))
    i = F.lit(index) if isinstance(index, int) else index
    return F.concat_ws("_", F.lit("section"), F.when(body == "", F.concat(F.lit("section_"), i)).otherwise(body), i)


def type_name(value: Column | str) -> Column:
    """A section type as a bare upper-case name: hyphens and blanks as underscores, without an enum's prefix."""
    return F.substring_index(F.upper(F.translate(F.trim(_c(value)), "- ", "__")), ".", -1)


def extraction_confidence(text: Column | str) -> Column:
    n = F.length(F.trim(F.coalesce(_c(text), F.lit(""))))
    return F.when(n == 0, 0.55).when(n < 40, 0.75).when(n < 120, 0.9).otherwise(1.0)


def uuid5(name: Column | str, space: str = DNS) -> Column:
    """Name-based id (RFC 4122 version 5)."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(_c(name), "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(standard: Column | str, clause: Column | str, part: Column, page: Column) -> Column:
    return F.concat(_c(standard), F.lit("_"), _c(clause), F.lit("_part"), part.cast("string"), F.lit("_p"), page.cast("string"))


def page_at(page_map: Column | str, offset: Column | str) -> Column:
    """Page in force at an offset: of the greatest marker not beyond it, else of the first; 1 without markers."""
    m, at = _c(page_map), _c(offset)
    keys = F.array_sort(F.map_keys(m))
    before = F.filter(keys, lambda k: k <= at)
    key = F.when(F.size(before) > 0, F.element_at(before, -1)).otherwise(F.get(keys, F.lit(0)))
    return F.coalesce(F.when(F.size(keys) > 0, F.element_at(m, key)), F.lit(1))
