"""Operators that SQL can't mirror, and edge cases, against plain Python."""

import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clauseworks import plans, sources, streaming
from clauseworks.functions import text as T
from clauseworks.operators import corpus, hooks, layout, pages, registry, retrieval, segment


def one(spark, column, **values):
    return spark.createDataFrame(pd.DataFrame([values])).select(column.alias("x")).first()["x"]


def test_uuid5_equals_the_standard(spark):
    names = ["a", "ISO_4.1_part1_p3", "é à", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.uuid5("n").alias("u")).collect()
    assert {r["n"]: r["u"] for r in rows} == {n: str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names}


@pytest.mark.parametrize(
    "number,title,want",
    [("5.1.1", "### 5.1.1\tLeadership", "Leadership"), ("4", None, "4"), ("4.1", "4.1", "4.1"), ("7", "x" * 90, "x" * 77 + "..."), ("8.1", "Scope", "Scope")],
)
def test_clean_title(spark, number, title, want):
    rows = spark.createDataFrame([(number, title)], "n string, t string")
    assert rows.select(T.clean_title("n", "t")).first()[0] == want


def test_tokens(spark):
    rows = spark.createDataFrame([("**Pump** the pump [x] 12 été à la cuve", "7.5.2", ["corrective action"])], "t string, c string, b array<string>")
    assert rows.select(T.index_tokens("t", "c", "b")).first()[0] == ["pump", "été", "cuve", "7", "5", "2", "corrective", "action"]
    assert rows.select(T.index_tokens("t", dedup=False)).first()[0] == ["pump", "pump", "été", "cuve"]
    assert rows.select(T.terms("t")).first()[0][-1] == "été cuve"


def test_canonical_line_and_slug(spark):
    assert one(spark, T.canonical_line("a"), a=" | Page 12 |  of 40 ") == "page <num> of <num>"
    assert one(spark, T.canonical_line("a"), a="|---|:--|") == "" and one(spark, T.canonical_line("a"), a="abc") == ""
    assert one(spark, T.slug("a", 3), a="Maîtrise des écarts !") == "section_maitrise_des_ecarts_3"


def test_page_at(spark):
    rows = spark.createDataFrame([({10: 2, 50: 3}, x) for x in (0, 10, 49, 50, 99)] + [({}, 5), (None, 5)], "m map<int,int>, at int")
    assert [r[0] for r in rows.select(T.page_at("m", "at")).collect()] == [2, 2, 2, 3, 3, 1, 1]


@pytest.mark.parametrize("words,most", [([3, 4, 2], 7), ([9, 1, 1], 5), ([2, 2, 2, 2], 4), ([1], 1)])
def test_paragraph_packing(spark, words, most):
    paragraphs = [" ".join(["w"] * n) for n in words]
    parts = one(spark, segment.pack_paragraphs(F.col("t"), most), t="\n\n".join(paragraphs))
    want, now = [], []
    for p in paragraphs:
        if now and sum(len(x.split()) for x in now) + len(p.split()) > most:
            want.append("\n\n".join(now))
            now = []
        now.append(p)
    assert parts == [*want, "\n\n".join(now)]


def test_note_blocks(spark):
    assert one(spark, segment.note_free(F.col("t")), t="It shall.\nNOTE 1: it may\nstill note\n\nIt should.") == "It shall.\n\nIt should."


def test_tree_parents(spark):
    levels = [1, 2, 3, 3, 2, 1, 3]
    rows = spark.createDataFrame([(1, i, x, "c") for i, x in enumerate(levels)], "parsed_id int, pos int, level int, clause_id string")
    got = [r["parent_pos"] for r in segment.parents(rows).orderBy("pos").collect()]
    assert got == [None, 0, 1, 1, 0, None, 5]


def test_write_modes(spark):
    base, new = (spark.createDataFrame(x, "norm_key string, v int") for x in ([("a", 1), ("b", 1)], [("b", 2), ("c", 2)]))
    rows = lambda mode: sorted(map(tuple, registry.write_norms(base, new, mode).collect()))
    assert rows("skip") == [("a", 1), ("b", 1), ("c", 2)] and rows("upsert") == [("a", 1), ("b", 2), ("c", 2)]
    with pytest.raises(RuntimeError):
        rows("error")
    with pytest.raises(ValueError):
        rows("merge")


def test_merge_parts_and_legacy(spark):
    parts = spark.createDataFrame([("n", "8.1", 2, 1, "b", "Second", None, True), ("n", "8.1", 1, 1, "a", "First", "T", False), ("n", "9.1", 1, 1, "c", "Only", "U", False)], "norm_key string, clause_number string, chunk_index int, page int, chunk_id string, text string, title string, has_requirements boolean")
    got = {r["clause_number"]: (r["text"], r["has_requirements"], r["title"]) for r in registry.merge_parts(parts).collect()}
    assert got == {"8.1": ("First\n\nSecond", 1, "T"), "9.1": ("Only", 0, "U")}
    old = spark.createDataFrame([("ISO1", "8.1", "")], "norm_id string, clause_number string, language string")
    row = registry.migrate_legacy(old).first()
    assert (row["norm_key"], row["top_level_family"]) == ("ISO1::EN", "8")


def test_dense_equals_brute_force_and_skips_bad_rows(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(100, None), (101, [0.0] * 8), (102, m[3].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.filter("vec_id in (3, 7, 100)").withColumnRenamed("vec_id", "query_id")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.dense_top_k(vectors, asked, 5).collect()}
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    order = [i for i in np.argsort(-unit @ unit[7], kind="stable")[:5]]
    assert [got[7, k] for k in range(1, 6)] == order and got[3, 1] == 3 and got[3, 2] == 102 and (100, 1) not in got


def test_fusion_and_errors(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, k string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "query_id int, k string, rank int")
    got = retrieval.fuse([a, b], "k", 5).orderBy("rank").collect()
    assert [r["k"] for r in got] == ["y", "x"] and got[0]["score"] == round(1 / 62 + 1 / 61, 9)
    with pytest.raises(ValueError):
        retrieval.norm_filter([])
    with pytest.raises(retrieval.EmptyCorpusError):
        retrieval.require_rows(a.limit(0), "nothing")


def test_query_vector_sums_collisions(spark):
    q = spark.createDataFrame([(1, ["a", "a", "b"]), (2, [])], "query_id int, tokens array<string>")
    got = corpus.query_vectors(q, "query_id").collect()
    assert sorted(r["weight"] for r in got) == [1.0, 2.0]


def test_vocabulary_needs_whole_words(spark):
    texts = spark.createDataFrame([(1, "The endroit and corrective  Action."), (2, "corrective actions"), (3, None)], "id int, t string")
    forms = spark.createDataFrame([("doit", "doit"), ("action", "corrective action")], "canonical string, form string")
    assert [tuple(r) for r in corpus.vocabulary_hits(texts, "id", "t", forms).collect()] == [(1, "action")]


def test_vocabulary_forms_of_any_length_and_with_marks(spark):
    texts = spark.createDataFrame([(1, "The risk-based plan of the auditor's team covers every site of the group."), (2, "Plan, team."), (3, None)], "id long, t string")
    forms = spark.createDataFrame([("a", "Risk-based plan"), ("b", "auditor's team"), ("c", "covers every site of the group"), ("d", "team"), ("e", "plan of team"), ("f", "-"), ("g", None)], "canonical string, form string")
    assert sorted(map(tuple, corpus.vocabulary_hits(texts, "id", "t", forms).collect())) == [(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "d")]
    assert corpus.vocabulary_hits(texts, "id", "t", forms.limit(0)).count() == 0


def test_edges_are_cut(spark):
    rows = [("d", p, f"ACME manual\nEdition 3 page {p}\nBody {chr(97 + p) * 8}\nmore {chr(107 + p) * 8}\nInternal use {p}") for p in range(1, 7)] + [("e", 1, "ACME manual\nBody"), ("e", 2, None)]
    df = spark.createDataFrame(rows, "doc string, page int, text string")
    got = {(r["doc"], r["page"]): r["text"] for r in pages.cut_edges(pages.edge_cuts(df)).collect()}
    assert got["d", 2] == "Body cccccccc\nmore mmmmmmmm" and got["e", 1] == "ACME manual\nBody" and got["e", 2] == ""
    lines = {r["line"] for r in layout.repeated_edges(df, "doc", "page", "text").collect()}
    assert lines == {"acme manual", "edition <num> page <num>", "internal use <num>"}


def test_title_pages_never_go_back(spark):
    sections = spark.createDataFrame([("d", 0, "Preamble"), ("d", 1, "Scope"), ("d", 2, "Terms"), ("d", 3, "Scope"), ("d", 4, "Gone")], "doc string, pos int, title string")
    texts = spark.createDataFrame([("d", ["intro scope", "the terms", "end"])], "doc string, page_texts array<string>")
    got = [r["page_start"] for r in pages.title_pages(sections, texts).orderBy("pos").collect()]
    assert got == [1, 1, 2, 2, 2]
    ranges = layout.page_ranges(spark.createDataFrame([("d", i, s, 9) for i, s in enumerate([1, 3, 3, 7])], "doc string, pos int, start int, total int"), "doc", "pos", "start", "total")
    assert [(r["page_start"], r["page_end"]) for r in ranges.orderBy("pos").collect()] == [(1, 2), (3, 3), (3, 6), (7, 9)]


def test_heading_repair_and_zone(spark):
    lines = ["Cover", "1 Scope", "4.4.1\nThe site shall", "#### 5.1.1", "Leadership", "## 6\nPlanning", "Annex A", "x"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc string, pos int, line string")
    got = [r["line"] for r in pages.repair_headings(df).orderBy("pos").collect()]
    assert got == ["Cover", "1 Scope", "### 4.4.1 The site shall", "#### 5.1.1 Leadership", "## 6 Planning", "Annex A", "x"]
    assert [r["pos"] for r in pages.clause_zone(df).orderBy("pos").collect()] == [1, 2, 3, 4, 5]


def test_heading_score(spark):
    on, off = F.lit(True), F.lit(False)
    score = lambda t, *a: one(spark, pages.heading_score(F.col("t"), *a), t=t)
    assert score("4.1 Scope", on, on, on, F.lit(30.0), F.lit(12.0), F.lit(5.0), F.lit(9.0)) == 3 + 3 + 2 + 2 + 1 + 1
    assert score("This is a sentence.", off, off, off, F.lit(None).cast("double"), F.lit(12.0), F.lit(9.0), F.lit(9.0)) == 0


def test_json_arrays(spark):
    rows = spark.createDataFrame([('[{"id": "a", "valid": true}]',), ('```json\n[{"id": "b", "valid": false}]\n```',), ('Sure: [{"id": "c", "valid": true}] done',), ("none",), (None,)], "t string")
    got = [r[0] for r in rows.select(pages.json_array(F.col("t"), "struct<id:string,valid:boolean>")).collect()]
    assert [x and x[0]["id"] for x in got] == ["a", "b", "c", None, None]


def test_boilerplate_counts_single_lines_twice(spark):
    rows = [("d", p, "header", "ACME") for p in range(1, 3)] + [("d", p, "body", f"text {p}") for p in range(1, 11)] + [("d", 1, "footer", "two\nlines")]
    df = spark.createDataFrame(rows, "doc string, page int, zone string, text string")
    assert {r["text"] for r in layout.boilerplate(df).collect()} == {"ACME"}


def test_table_markdown(spark):
    df = spark.createDataFrame([([["a", None], ["b\nc", "d"]],)], "c array<array<string>>")
    assert df.select(layout.table_markdown(F.col("c"))).first()[0] == "| a |  |\n| --- | --- |\n| b c | d |"


def test_embedding_hook_records_failures(spark):
    def fragile(texts):
        if any("bad" in t for t in texts):
            raise hooks.PermanentError("no")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "id int, t string")
    done = hooks.embed(rows, "t", fragile, tries=2, wait=0)
    assert {r["id"]: (r["embedding"], r["error"]) for r in done.collect()} == {1: ([2.0], None), 2: (None, "no"), 3: ([0.0], None)}
    with pytest.raises(RuntimeError):
        hooks.check_failures(done, 0.3)
    assert hooks.check_failures(done, 0.5) == pytest.approx(1 / 3)
    with pytest.raises(RuntimeError):
        hooks.check_collection({"model": "a", "sparse_dimension": 3}, "b", 3)


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.PDF").write_bytes(b"one\ftwo")
    (tmp_path / "in" / "b.pdf").write_bytes(b"\xff")
    (tmp_path / "in" / "c.txt").write_bytes(b"no")
    files = sources.read_files(spark, str(tmp_path / "in"))
    pages_of = lambda path, content: [(path[-5:], i, 0, "body", t, 9.0) for i, t in enumerate(content.decode().split("\f"), 1)]
    assert sorted(r["text"] for r in sources.decode(files, pages_of).collect()) == ["one", "two"]
    rows = spark.createDataFrame([("c1", "d", "s1", 2), ("c1", "d", "s0", 1), ("c2", "d", "s0", 1)], "company_id string, doc_id string, section_id string, page_start int")
    sources.write_sections(rows, str(tmp_path / "s"))
    assert [r["section_id"] for r in sources.read_sections(spark, str(tmp_path / "s"), "c1", "d").collect()] == ["s0", "s1"]
    with pytest.raises(ValueError):
        sources.read_sections(spark, str(tmp_path / "s"), "", "d")
    path = sources.write_registry(rows, str(tmp_path / "r"), "20260101")
    assert spark.read.json(path).count() == 3 and spark.read.json(str(tmp_path / "r" / "latest")).first()["path"] == path


def test_stream_upsert_is_idempotent(spark, tmp_path):
    schema = "id int, v int"
    write = lambda rows, n: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / n))
    write([(1, 1), (2, 1)], "a")
    run = lambda: streaming.upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), ["id"], "v", str(tmp_path / "state"), str(tmp_path / "check"))
    run()
    write([(2, 5), (3, 1), (1, 0)], "b")
    run()
    run()
    got = {r["id"]: r["v"] for r in streaming.latest_state(spark, str(tmp_path / "state"), spark.createDataFrame([], schema).schema).collect()}
    assert got == {1: 1, 2: 5, 3: 1}


def test_retrieval_plan(spark):
    clauses = spark.createDataFrame([(i, "N1", "EN", "8", f"8.{i}", f"The {w} shall be kept clean and dry") for i, w in enumerate(["pump", "tank", "valve", "silo"])], "clause_uid long, norm_id string, language string, top_level_family string, clause_number string, text string")
    chunks, sparse = plans.index_clauses(clauses)
    queries = spark.createDataFrame([(1, "clean valve"), (2, "silo")], "query_id long, query string")
    got = {r["query_id"]: r["clause_number"] for r in plans.retrieve(chunks, sparse, queries, ["N1"], "EN").filter("place = 1").collect()}
    assert got == {1: "8.2", 2: "8.3"}
    with pytest.raises(retrieval.EmptyCorpusError):
        plans.retrieve(chunks, sparse, queries, ["other"])
