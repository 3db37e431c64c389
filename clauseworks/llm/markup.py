"""Problem 3: markup residue turned into clean text that keeps headings, lists, tables, code and formulas apart.

Method: code and formulas are set aside first (what stands inside them counts for nothing), then the constructs of each markup
language are read into typed blocks, each with the kinds of markup it held. Two passes label the blocks: stop-word density, length
and link density decide the clear ones (content or furniture); short ambiguous blocks inherit the label of the nearest decided
neighbour. The kinds of a document are those of its labelled blocks; marks around no text at all make a block of type residue.

Amounts, Windows paths, comparison signs and key names are text. Null and blank documents have no kinds and no blocks; repeated
rows of a document give equal results and count once. Whole documents are read, in time proportional to their length: what an
opening mark begins is searched for once, and lines are scanned without backtracking. Private-use characters of the input become
blanks, as the reading itself uses some.
"""

from __future__ import annotations

import functools
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import over_batches, widen
from .language import FUNCTION_WORDS

STOP_WORDS = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())
#: A block with at least LONG characters and STOP_SHARE stop words is content; above LINK_SHARE of linked text it is furniture.
LONG, SHORT, STOP_SHARE, LINK_SHARE = 140, 60, 0.18, 0.5

# Names of HTML elements and of LaTeX commands.
_TAGS = "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav ol option p pre q s samp script section select small span strike strong style sub summary sup table tbody td textarea tfoot th thead title tr tt u ul var video"
_TAG = re.compile(rf"<(/?)({'|'.join(_TAGS.split())})(\s[^<>]*)?/?>", re.I)
_HREF = re.compile(r"\bhref\s*=", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8}\d?);")
_COMMANDS = (
    "section subsection subsubsection chapter paragraph part title author item begin end emph textbf textit texttt textsc underline label ref cite citep citet footnote caption includegraphics usepackage documentclass maketitle"
    " frac sqrt bar hat vec cdot times leq geq neq approx sigma alpha beta gamma delta mu pi sum int infty left right text mathrm quad ldots dots hline newline noindent centering href url par bf it tt"
)
_COMMAND = re.compile(rf"~?\\(?:(?:{'|'.join(_COMMANDS.split())})(?![A-Za-z])|[A-Za-z]+\*?(?=[{{\[]))")
_PATH = re.compile(r"(?<![A-Za-z])[A-Za-z]:\\[^\s<>\"|]*|\\\\\w[\w.$-]*\\[^\s<>\"|]*")
_FENCE = re.compile(r"^[ \t]{0,3}(`{3,}|~{3,})[^\n`]*\n(.*?)(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\Z)", re.M | re.S)
# Opening marks and what closes each; the search for an end that never comes is made once a text.
_PRE = re.compile(r"<(pre)\b[^<>]*>\s*(?:<code\b[^<>]*>)?", re.I)
_VERBATIM = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted)\}(?:\[[^\]\[\n]*\])?")
_WIKI_CODE = re.compile(r"<(syntaxhighlight|source|nowiki)\b[^<>]*>", re.I)
_DROPPED = re.compile(r"<(script|style)\b[^<>]*>", re.I)
_COMMENT = re.compile(r"<!--")
_HTML_CODE = re.compile(r"<(code|kbd|samp|tt)\b[^<>]*>", re.I)
_SPAN = re.compile(r"(?<![`\\])(`{1,2})(?!`)([^`\n]*(?:\n[^`\n]+)?)(?<!`)\1(?!`)")
_DISPLAY = re.compile(r"(\$\$)(?=\S)|(\\\[)(?=.)|\\begin\{((?:equation|align|gather|displaymath|math|eqnarray)\*?)\}(?=.)", re.S)
_PARENTHESES = re.compile(r"\\\((?=.)", re.S)
_INLINE = re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]{1,200}?)(?<=[^\s\\])\$(?![\d$])")
_MATHS = re.compile(r"[\\^_={}<>+]|^[A-Za-z]$")
_INDENTED = re.compile(r"(?:(?<=\n\n)|\A)(?:(?: {4}|\t)[^\n]*\S[^\n]*(?:\n|\Z))+", re.M)
_WIKI_INDENTED = re.compile(r"(?:(?<=\n\n)|\A)(?: (?! )[^\n]*\S[^\n]*(?:\n|\Z))+")

_MD_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S[^\n]*)$", re.M)
_UNDERLINE = re.compile(r"\n {0,3}(={2,}|-{2,})[ \t]*$", re.M)
_NO_TITLE, _LETTER = re.compile(r"[ \t]*[|>#=]"), re.compile(r"[^\W_]")
_STARS = re.compile(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])((?:(?!\n\s*\n)[^*]){1,300}?)(?<=[^\s*\\])\1(?![\w*])")
_UNDERSCORES = re.compile(r"(?<![\w\\])(_{1,3})(?=[^\s_])((?:(?!\n\s*\n)[^_]|(?<=\w)_(?=\w)){1,300}?)(?<=[^\s_\\])\1(?!\w)")
_STRIKE = re.compile(r"~~(?=\S)([^~\n]+?)(?<=\S)~~")
_LINK = re.compile(r"!?\[([^\[\]\n]*(?:\n[^\[\]\n]+)?)\]\(\s*<?([^()\s<>]+)>?(?:\s+\"[^\"\n]*\")?\s*\)")
_LINK_REF = re.compile(r"^ {0,3}\[[^\]\n]+\]:[ \t]+\S+[^\n]*$", re.M)
_AUTOLINK = re.compile(r"<((?:https?|mailto|ftp):[^<>\s]+)>")
_MD_RULE = re.compile(r"^[ \t]*(?:\|[ \t]*)?:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+(?:\|[ \t]*)?$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$", re.M)
_QUOTE = re.compile(r"(?:(?<=\n\n)|\A)(?: {0,3}> ?(?!\d)\S[^\n]*(?:\n|\Z))+")
_WIKI_HEADING = re.compile(r"^(={1,6})([^=\n]+)\1[ \t]*$", re.M)
_APOSTROPHES = re.compile(r"(?<![\w'])('{2,3}|'{5})(?=[^\s'])((?:(?!\n\s*\n)[^']|'(?!')){1,300}?)(?<=\S)\1(?![\w'])")
_WIKI_LINK = re.compile(r"\[\[(?:([^\[\]|\n]*)\|)?([^\[\]|\n]+)\]\]")
_WIKI_CATEGORY = re.compile(r"\[\[(?:category|catégorie|kategorie|categoría|categoria)\s*:[^\]\n]*\]\]", re.I)
_TEMPLATE = re.compile(r"\{\{([^{}\n|]+)(?:\|([^{}\n]*))?\}\}")
_WIKI_TABLE, _WIKI_TABLE_END = re.compile(r"^\{\|[^\n]*\n", re.M), re.compile(r"^\|\}", re.M)
_LATEX_HEADING = re.compile(r"\\(chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}\n]*)\}")
_LATEX_LEVEL = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
_LATEX_TABLE = re.compile(r"\\begin\{(tabular\*?|array|tabularx|longtable)\}(?:\{[^{}]*\})*")
_LATEX_DROP = re.compile(r"~?\\(?:label|cite[pt]?|ref|includegraphics|usepackage|documentclass|vspace|hspace)\*?(?:\[[^\]\[\n]*\])?\{[^{}]*\}|\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\[\n]*\])?|\\(?:maketitle|hline|centering|noindent)\b")
_LATEX_ARG = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\[\n]*\])?\{([^{}]*)\}")
_LATEX_ESCAPE = re.compile(r"\\([&%$#_{}])")
_LIST = re.compile(r"^[ \t]*(?:[-*+•–]|\(?(?:\d{1,3}|[a-z])[.)]|[*#]{1,4})[ \t]+(?=\S)")
_BREAK = re.compile(r"\n[ \t]*\n+")

#: Private-use characters that mark what was set aside, where headings, items and rows begin, and where linked text begins and ends (first as read, then paired within lines).
O, C, HEAD, ITEM, ROW, LINK, UNLINK, FROM, TO = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004", "\ue005", "\ue006", "\ue007", "\ue008"
_LINKED = re.compile(f"{LINK}([^{LINK}{UNLINK}]*){UNLINK}")
_LINKED_LINE = re.compile(rf"(?m)^([ \t]*(?:(?:{HEAD}\d|{ITEM}|{ROW})[ \t]*)?)(\S[^\n]*)$")
_MARKED = re.compile(f"{FROM}([^{FROM}{TO}]*){TO}")


#: And those that tell which kind of markup stood at a place.
KIND_MARKS = {"html": "\ue010", "markdown": "\ue011", "wiki": "\ue012", "latex": "\ue013"}
_KIND_MARK = re.compile(f"[{''.join(KIND_MARKS.values())}]")
_KIND_OF = {v: k for k, v in KIND_MARKS.items()}
_PRIVATE = re.compile("[\ue000-\ue01f]")

Block = tuple[str, int, str, float]


@functools.lru_cache(256)
def _closing(before: str, name: str, after: str) -> re.Pattern:
    return re.compile(before + re.escape(name) + after, re.I)


def dissect(text: str) -> tuple[set[str], list[Block]]:
    """Kinds of markup, and blocks (type, level, clean text, share of linked text) of one document."""
    blocks, kinds = marked_blocks(text)
    return set().union(*kinds), [b for b in blocks if b[0] != "residue"]


def marked_blocks(text: str) -> tuple[list[Block], list[set[str]]]:
    """Blocks of one document, and the kinds of markup in each."""
    t = (_PRIVATE.sub(" ", text) if _PRIVATE.search(text) else text).replace("\r\n", "\n").replace("\r", "\n")
    kinds: set[str] = set()
    kept: list[tuple[str, str]] = []

    def keep(kind: str, body: str, apart: bool = False) -> str:
        inner = "".join(_KIND_MARK.findall(body))
        kept.append((kind, _KIND_MARK.sub("", body) if inner else body))
        mark = f"{O}{len(kept) - 1}{C}{inner}"
        return f"\n\n{mark}\n\n" if apart else mark

    def marked(kind: str, got: str) -> str:
        """The replacement with the mark of its kind at the end of its last line."""
        if not kind:
            return got
        kinds.add(kind)
        end = len(got.rstrip("\n"))
        return got[:end] + KIND_MARKS[kind] + got[end:]

    def take(pattern: re.Pattern, kind: str, put, sign: str = "") -> None:
        nonlocal t
        if sign and sign not in t:
            return

        def one(m: re.Match) -> str:
            got = put(m)
            return m.group() if got is None else marked(kind, got)

        t = pattern.sub(one, t)

    def between(opening: re.Pattern, closing, kind: str, put, sign: str) -> None:
        """What stands from an opening mark to the first closing one after it."""
        nonlocal t
        if sign not in t:
            return
        out, at, gone = [], 0, set()
        for m in opening.finditer(t):
            end = closing(m)
            if m.start() < at or end in gone:
                continue
            z = end.search(t, m.end())
            if z is None:
                gone.add(end)
                continue
            out += [t[at : m.start()], marked(kind, put(t[m.end() : z.start()]))]
            at = z.end()
        t = "".join([*out, t[at:]])

    tag_end = lambda m: _closing("</", m[1].lower(), r"\s*>")
    latex_end = lambda m: _closing(r"\\end\{", m[1], r"\}")
    formula_end = lambda m: _closing("", "$$", "") if m[1] else _closing("", "\\]", "") if m[2] else _closing(r"\\end\{", m[3], r"\}")

    def preformatted(body: str) -> str:
        body = body.rstrip()
        return keep("code", html.unescape(body[:-7] if body.lower().endswith("</code>") else body).strip("\n"), True)

    def not_code(lines: str) -> bool:
        return bool(_LIST.match(lines)) or not _KIND_MARK.sub("", lines).strip()

    # code and formulas stand aside
    take(_FENCE, "markdown", lambda m: keep("code", m[2].strip("\n"), True))
    between(_PRE, tag_end, "html", preformatted, "<")
    between(_VERBATIM, latex_end, "latex", lambda body: keep("code", body.strip("\n"), True), "\\begin")
    between(_WIKI_CODE, tag_end, "wiki", lambda body: keep("code", body.strip("\n"), "\n" in body), "<")
    between(_DROPPED, tag_end, "html", lambda body: " ", "<")
    between(_COMMENT, lambda m: _closing("", "-->", ""), "html", lambda body: " ", "<!--")
    between(_HTML_CODE, tag_end, "html", lambda body: keep("span", html.unescape(body)), "<")
    take(_SPAN, "markdown", lambda m: keep("span", m[2]) if m[2].strip() else None, "`")
    take(_PATH, "", lambda m: keep("span", m[0]), "\\")
    between(_DISPLAY, formula_end, "latex", lambda body: keep("formula", body.strip(), True), "$$" if "\\" not in t else "")
    between(_PARENTHESES, lambda m: _closing("", "\\)", ""), "latex", lambda body: keep("math", body), "\\(")
    take(_INLINE, "latex", lambda m: keep("math", m[1]) if _MATHS.search(m[1]) else None, "$")
    take(_INDENTED, "", lambda m: None if not_code(m[0]) else keep("code", re.sub(r"(?m)^(?: {4}|\t)", "", m[0]).rstrip("\n"), True))
    take(_WIKI_INDENTED, "", lambda m: None if not_code(m[0]) else keep("code", re.sub(r"(?m)^ ", "", m[0]).rstrip("\n"), True))

    # LaTeX
    if "\\" in t:
        if _COMMAND.search(t):
            kinds.add("latex")
            t = _COMMAND.sub(lambda m: KIND_MARKS["latex"] + m[0], t)
        if "latex" in kinds:
            t = re.sub(r"(?m)(?<!\\)^%[^\n]*\n?", "", t)
            take(_LATEX_HEADING, "", lambda m: f"\n\n{HEAD}{_LATEX_LEVEL[m[1]]}{m[2]}\n\n")
            between(_LATEX_TABLE, latex_end, "", lambda body: "\n\n" + "".join(f"{ROW}{' | '.join(c.strip() for c in re.split(r'(?<!\\)&', r))}\n" for r in re.split(r"\\\\", body) if r.replace("\\hline", "").strip()) + "\n", "\\begin")
            t = re.sub(r"\\item\b(?:\[[^\]]*\])?[ \t]*", f"\n{ITEM}", t)
            t = _LATEX_DROP.sub("", t)
            for _ in range(4):
                t, n = _LATEX_ARG.subn(r"\1", t)
                if not n:
                    break
            t = t.replace("\\\\", "\n")
        t = _LATEX_ESCAPE.sub(r"\1", t)

    # wiki
    between(_WIKI_TABLE, lambda m: _WIKI_TABLE_END, "wiki", lambda body: "\n\n" + "".join(f"{ROW}{' | '.join(c.strip() for c in re.split(r'[|!]{2}', re.sub(r'^[|!]', '', r.strip())))}\n" for r in body.split("\n") if r.strip() and not r.startswith("|-")) + "\n", "{|")
    take(_WIKI_HEADING, "wiki", lambda m: f"\n\n{HEAD}{len(m[1])}{m[2].strip()}\n\n" if m[2].strip() else None, "=")
    take(_WIKI_CATEGORY, "wiki", lambda m: "", "[[")
    take(_WIKI_LINK, "wiki", lambda m: f"{LINK}{m[2]}{UNLINK}", "[[")
    take(_TEMPLATE, "wiki", lambda m: m[2].split("|")[-1] if m[2] else "", "{{")
    for _ in range(2):
        take(_APOSTROPHES, "wiki", lambda m: m[2], "''")

    # Markdown
    take(_MD_HEADING, "markdown", lambda m: f"\n\n{HEAD}{len(m[1])}{m[2].rstrip().rstrip('#').rstrip() or m[2].rstrip()}\n\n", "#")
    take(_MD_RULE, "markdown", lambda m: ROW, "--")
    out, at = [], 0
    for m in _UNDERLINE.finditer(t):
        start = t.rfind("\n", at, m.start()) + 1 or at
        title = t[start : m.start()]
        if m.start() > at and not _NO_TITLE.match(title) and _LETTER.search(title):
            out += [t[at:start], marked("markdown", f"\n\n{HEAD}{1 if m[1][0] == '=' else 2}{title.strip()}\n\n")]
            at = m.end()
    t = "".join([*out, t[at:]])
    take(_LINK, "markdown", lambda m: m[1] if m[0][0] == "!" else f"{LINK}{m[1]}{UNLINK}", "](")
    take(_LINK_REF, "markdown", lambda m: "", "]:")
    take(_AUTOLINK, "markdown", lambda m: f"{LINK}{m[1]}{UNLINK}", "<")
    take(_QUOTE, "markdown", lambda m: re.sub(r"(?m)^ {0,3}> ?", "", m[0]), ">")
    for _ in range(2):
        take(_STARS, "markdown", lambda m: m[2], "*")
        take(_UNDERSCORES, "markdown", lambda m: m[2], "_")
    take(_STRIKE, "markdown", lambda m: m[1], "~~")

    # HTML
    def tag(m: re.Match) -> str:
        name, closing = m[2].lower(), bool(m[1])
        if re.fullmatch(r"h[1-6]", name):
            return "\n\n" if closing else f"\n\n{HEAD}{name[1]}"
        if name in ("li", "dt", "dd"):
            return "\n" if closing else f"\n{ITEM}"
        if name == "tr":
            return "\n" if closing else f"\n{ROW}"
        if name in ("td", "th"):
            return " | " if closing else ""
        if name == "a":
            return UNLINK if closing else LINK if _HREF.search(m[3] or "") else ""
        if name == "br":
            return "\n"
        if name in ("p", "div", "ul", "ol", "table", "blockquote", "section", "article", "header", "footer", "nav", "body", "html", "hr", "dl"):
            return "\n\n"
        return ""

    take(_TAG, "html", tag, "<")
    take(_ENTITY, "html", lambda m: None if html.unescape(m[0]) == m[0] else html.unescape(m[0]), "&")

    t = _LINKED.sub(lambda m: _LINKED_LINE.sub(rf"\1{FROM}\2{TO}", m[1]), t).replace(LINK, "").replace(UNLINK, "")
    return _blocks(t, kept)


def _blocks(t: str, kept: list[tuple[str, str]]) -> tuple[list[Block], list[set[str]]]:
    def fill(s: str) -> str:
        return re.sub(f"{O}(\\d+){C}", lambda m: (f"${kept[int(m[1])][1]}$" if kept[int(m[1])][0] == "math" else kept[int(m[1])][1]), s)

    out: list[Block] = []
    kinds: list[set[str]] = []
    seen: set[str] = set()  # kinds since the last block

    def add(kind: str, level: int, s: str, links: float) -> None:
        out.append((kind, level, s, links))
        kinds.append(set(seen))
        seen.clear()

    for chunk in _BREAK.split(t):
        lines: list[str] = []
        held: set[str] = set()  # kinds in these lines

        def paragraph() -> None:
            s, links = _link_share(fill(" ".join(" ".join(lines).split())))
            later = seen - held
            seen.update(held)
            if s:
                add("paragraph", 0, s, links)
                seen.update(later)
            lines.clear()
            held.clear()

        for line in chunk.split("\n"):
            own = set(map(_KIND_OF.get, _KIND_MARK.findall(line)))
            line = _KIND_MARK.sub("", line) if own else line
            s = line.strip()
            if not s:
                (held if lines else seen).update(own)
                if own:
                    paragraph()
                continue
            alone = re.fullmatch(f"{FROM}?{O}(\\d+){C}{TO}?", s)
            code = alone and kept[int(alone[1])][0] in ("code", "formula", "math")
            item = s[0] == ITEM or _LIST.match(line.replace(FROM, ""))
            row = s[0] == ROW or (s[0] == "|" and s.count("|") >= 2)
            if not (code or s[0] == HEAD or item or row):
                lines.append(s)
                held |= own
                continue
            paragraph()
            seen |= own
            if code:
                kind, body = kept[int(alone[1])]
                add("code" if kind == "code" else "formula", 0, body, 0.0)
            elif s[0] == HEAD:
                add("heading", int(s[1]) if s[1:2].isdigit() else 1, _link_share(fill(s[2:].strip()))[0], 0.0)  # titles are often links to themselves
            elif item:
                lead = FROM if s[0] == FROM else ""
                body, links = _link_share(fill(s[1:].strip() if s[0] == ITEM else lead + _LIST.sub("", line.replace(lead, "", 1)).strip()))
                if body:
                    add("list_item", 0, body, links)
            else:
                body, links = _link_share(fill(s.strip(f"{ROW}| \t")))
                if body:
                    add("table_row", 0, " | ".join(c.strip() for c in body.split("|")), links)
        paragraph()
    if seen and out:
        kinds[-1] |= seen
    elif seen:
        add("residue", 0, "", 0.0)
    return out, kinds


_URL = re.compile(r"https?://\S+|www\.\S+")


def _link_share(s: str) -> tuple[str, float]:
    """The text without the marks of links, and the share of it that is linked or a bare address."""
    plain = s.replace(FROM, "").replace(TO, "").strip() if FROM in s else s
    linked = sum(len(x) for x in _MARKED.findall(s)) + sum(map(len, _URL.findall(_MARKED.sub(" ", s))))
    return plain, linked / max(len(plain), 1)


def label_blocks(blocks: list[tuple[str, int, str, float]]) -> list[str]:
    """content or furniture of each block: clear cases by density and length, short ambiguous ones by their nearest decided neighbour."""
    labels: list[str | None] = []
    for kind, _, s, links in blocks:
        words = [w.strip(".,;:()'\"").lower() for w in s.split()]
        stops = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
        if links > LINK_SHARE or kind == "residue":
            labels.append("furniture")
        elif kind in ("code", "formula", "table_row"):
            labels.append("content")
        elif len(s) >= LONG and stops >= STOP_SHARE or kind in ("heading", "list_item") and stops > 0:
            labels.append("content")
        elif kind == "paragraph" and len(s) <= SHORT and (s.count("|") >= 2 or not any(ch.isalpha() for ch in s)):
            labels.append("furniture")
        elif len(s) >= LONG and stops == 0:
            labels.append("furniture")
        else:
            labels.append(None)
    decided = [i for i, x in enumerate(labels) if x]
    out = []
    for i, x in enumerate(labels):
        if x is None:
            near = min(decided, key=lambda k: (abs(k - i), k), default=None) if len(decided) < 64 else _nearest(decided, i)
            x = labels[near] if near is not None else "content"
        out.append(x)
    return out


def _nearest(decided: list[int], i: int) -> int:
    from bisect import bisect

    k = bisect(decided, i)
    around = decided[max(0, k - 1) : k + 1]
    return min(around, key=lambda d: (abs(d - i), d))


BLOCK = "array<struct<block_no:int,block_type:string,level:int,label:string,text:string,markup:array<string>>>"
_BLOCK_ARROW = pa.list_(pa.struct([("block_no", pa.int32()), ("block_type", pa.string()), ("level", pa.int32()), ("label", pa.string()), ("text", pa.string()), ("markup", pa.list_(pa.string()))]))


def _convert(batches, texts: bool = True):
    for b in batches:
        kinds, blocks = [], []
        for text in b.column(1).to_pylist():
            own, held = marked_blocks(text) if text and not text.isspace() else ([], [])
            rows = [(label, block, sorted(k)) for label, block, k in zip(label_blocks(own), own, held)]
            kinds.append(sorted({k for label, _, ks in rows if label in LABELS for k in ks}))
            blocks.append([{"block_no": i, "block_type": k, "level": n, "label": label, "text": s if texts else None, "markup": ks} for i, (label, (k, n, s, _), ks) in enumerate(rows)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(blocks, _BLOCK_ARROW)], ["parsed_id", "kinds", "blocks"])


LABELS = ("content", "furniture")


def convert(documents: DataFrame, texts: bool = True) -> DataFrame:
    """parsed_id, kinds, blocks of documents(parsed_id, markdown); without texts the blocks tell only their type, label and markup."""
    return over_batches(widen(documents.select("parsed_id", "markdown")).filter("parsed_id is not null"), lambda batches: _convert(batches, texts), f"parsed_id long, kinds array<string>, blocks {BLOCK}")


def kinds_of_blocks(converted: DataFrame) -> DataFrame:
    """parsed_id, markup_kind: the kinds of markup in the blocks that the two passes kept or put aside, each once."""
    blocks = F.filter("blocks", lambda x: x["label"].isin(*LABELS))
    kinds = F.array_distinct(F.flatten(F.transform(blocks, lambda x: x["markup"])))
    return converted.select("parsed_id", F.explode(kinds).alias("markup_kind")).distinct()


def clean_text(converted: DataFrame) -> DataFrame:
    """parsed_id, clean_text: the content blocks with plain marks: # headings, - items, | rows, indented code, $ formulas."""
    b = lambda x: F.when(x["block_type"] == "heading", F.concat(F.repeat(F.lit("#"), x["level"]), F.lit(" "), x["text"])).when(x["block_type"] == "list_item", F.concat(F.lit("- "), x["text"])).when(x["block_type"] == "table_row", F.concat(F.lit("| "), x["text"], F.lit(" |"))).when(x["block_type"] == "code", F.concat(F.lit("    "), F.regexp_replace(x["text"], "\n", "\n    "))).when(x["block_type"] == "formula", F.concat(F.lit("$$ "), x["text"], F.lit(" $$"))).otherwise(x["text"])
    content = F.filter("blocks", lambda x: x["label"] == "content")
    return converted.select("parsed_id", F.array_join(F.transform(content, b), "\n\n").alias("clean_text"))
