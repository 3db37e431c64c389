import time

import pytest

from clauseworks.llm import markup as M

KINDS = [
    ("plain text, R&D, < 5 mm and loads > 30 kg, 3 * 4 = 12, C:\\archives\\2024, tank_level_max", set()),
    ("* one\n* two\n\n1. three", set()),
    ("a stray </p> tag", {"html"}),
    ("caf&eacute; open", {"html"}),
    ("# Scope\n\ntext", {"markdown"}),
    ("Scope\n=====\n\ntext", {"markdown"}),
    ("see [this](doc/a.md) and `code *x*`", {"markdown"}),
    ("```\n<b>[[x]]</b> \\emph{y}\n```", {"markdown"}),
    ("== Scope ==\n\n''word'' and [[link|text]]", {"wiki"}),
    ("\\section{Scope} and \\emph{x}", {"latex"}),
    ("the value $E = m c^2$ holds", {"latex"}),
    ("between $ 40 and $ 60 per unit", set()),
    ("<pre><code>**x** == y ==</code></pre>", {"html"}),
    ("", set()),
]


@pytest.mark.parametrize("text,kinds", KINDS)
def test_kinds(text, kinds):
    assert M.dissect(text)[0] == kinds


def test_structure_is_kept():
    text = "# Scope\r\n\r\nThe **pump** is off.\r\n\r\n- first\r\n- second\r\n\r\n| a | b |\r\n|---|---|\r\n| 1 | 2 |\r\n\r\n$$x^2$$\r\n\r\n```\r\ncount = 0\r\n```"
    blocks = [(k, s) for k, _, s, _ in M.dissect(text)[1]]
    assert blocks == [("heading", "Scope"), ("paragraph", "The pump is off."), ("list_item", "first"), ("list_item", "second"), ("table_row", "a | b"), ("table_row", "1 | 2"), ("formula", "x^2"), ("code", "count = 0")]


def test_html_and_latex_lists():
    assert [s for k, _, s, _ in M.dissect("<ul><li>a<li>b</ul>")[1] if k == "list_item"] == ["a", "b"]
    assert [s for k, _, s, _ in M.dissect("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}")[1] if k == "list_item"] == ["a", "b"]


def test_short_blocks_inherit():
    long = "The operator of the line shall keep the record of the pump in the archive and it is to be shown to the auditor on demand, as is the plan of the area and the list."
    labels = M.label_blocks([("paragraph", 0, long, 0.0), ("paragraph", 0, "Valid now", 0.0), ("paragraph", 0, "Home | Search | Contact", 0.0)])
    assert labels == ["content", "content", "furniture"]


LONG = "The operator of the line shall keep the record of the pump in the archive and it is to be shown to the auditor on demand, as is the plan of the area and the list."
MENUS = [
    "- [Home](index.md)\n- [Search](search.md)\n- [Contact](contact.md)",
    "* [[Start|Home]]\n* [[Suche|Search]]\n* [[Contact]]",
    '<ul><li><a href="/">Home</a></li><li><a href="/s">Search</a><li><a href="/c">Contact\n</a></ul>',
    "1. <http://a.example/home>\n2. [Search](s.md)\n3. [Contact](c.md)",
]


@pytest.mark.parametrize("menu", MENUS)
def test_link_menus_are_furniture(menu):
    blocks = M.dissect(f"{LONG}\n\n{menu}\n\n{LONG}")[1]
    assert [k for k, *_ in blocks] == ["paragraph", "list_item", "list_item", "list_item", "paragraph"]
    assert M.label_blocks(blocks) == ["content", "furniture", "furniture", "furniture", "content"]
    assert [s for _, _, s, _ in blocks][2:4] == ["Search", "Contact"]


def test_links_within_text_stay_content():
    for text in (LONG.replace("record", "[record](r.md)"), LONG.replace("record", '<a href="r">record</a>'), f'<a name="top">{LONG}', f'<a href="r">{LONG}'):
        (block,) = M.dissect(text)[1]
        assert block[2] == LONG and block[3] < 0.1 and M.label_blocks([block]) == ["content"]
    blocks = M.dissect("# [Scope](#scope)\n\n| [a](b) | the value of the pump |\n|---|---|\n| 1 | 2 |")[1]
    assert [s for _, _, s, _ in blocks] == ["Scope", "a | the value of the pump", "1 | 2"] and set(M.label_blocks(blocks)) == {"content"}


def test_kinds_stand_with_their_blocks():
    text = "# Scope\n\nThe **pump** is off.\n\n- plain item\n\n<b>Check</b> it.\n\n```\n''x''\n```\n\n<!-- end -->"
    blocks, kinds = M.marked_blocks(text)
    assert [b[0] for b in blocks] == ["heading", "paragraph", "list_item", "paragraph", "code"]
    assert kinds == [{"markdown"}, {"markdown"}, set(), {"html"}, {"markdown", "html"}]  # a mark without text goes to the block before
    blocks, kinds = M.marked_blocks("<!-- only -->")
    assert [b[0] for b in blocks] == ["residue"] and kinds == [{"html"}] and M.label_blocks(blocks) == ["furniture"]
    assert M.dissect("a \ue010 b") == (set(), [("paragraph", 0, "a b", 0.0)])


OPENERS = ["The pump is closed by the operator. ", "<pre>x ", "<pre ", "<code> ", "<script>", "<!-- x ", "{|\n|a\n", "\\begin{verbatim} x ", "\\begin{equation} ", "\\begin{tabular} ", "\\[ x ", "\\( x ", "\\emph[", "\\emph{", "**a ", "__a ", "`a ", "[a", "[[a", "{{a", " ", "= a ", "# a ", "~~a ", "a\n--\n", "- a\n"]


@pytest.mark.parametrize("unit", OPENERS)
def test_time_is_proportional_to_length(unit):
    """Long lines and marks that nothing closes: four times the text takes about four times as long."""
    spent = []
    for n in (30_000, 120_000):
        text = (unit * (n // len(unit) + 1))[:n]
        began = time.process_time()
        M.label_blocks(M.dissect(text)[1])
        spent.append(time.process_time() - began)
    assert spent[1] < 8 * max(spent[0], 0.05)


def test_kinds_come_from_labelled_blocks(spark):
    rows = spark.createDataFrame([(1, "# a\n\n<i>b</i>"), (1, "# a\n\n<i>b</i>"), (2, "plain"), (3, "<!-- -->"), (4, None)], "parsed_id long, markdown string")
    found = M.kinds_of_blocks(M.convert(rows, texts=False)).collect()
    assert sorted(map(tuple, found)) == [(1, "html"), (1, "markdown"), (3, "html")]


def test_convert_handles_nulls_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "# a", 5), (3, "# a", 5), (None, "# a", 5)], "parsed_id long, markdown string, kinds int")
    got = {r["parsed_id"]: r["kinds"] for r in M.convert(rows).collect()}
    assert got == {1: [], 2: [], 3: ["markdown"]}
    assert M.convert(rows.limit(0)).count() == 0
    assert {r["clean_text"] for r in M.clean_text(M.convert(rows.filter("parsed_id = 3"))).collect()} == {"# a"}
