"""Files, collections, verdicts and gates: errors, defaults, nulls, empty tables and odd names."""

import json

import pytest
from pyspark.sql import functions as F

from clauseworks import plans, sources
from clauseworks.functions import text as T
from clauseworks.operators import corpus, hooks, ingest, layout, pages, registry, retrieval, segment

from test_operators import one


@pytest.mark.parametrize(
    "text,want",
    [("NOTE 1: may\nmore\n\nIt shall.", "\nIt shall."), ("a\n  Example 2 x\nb\n\nc", "a\n\nc"), ("plain", "plain"), ("", ""), ("note only", ""), ("a\nNOTE x", "a"), ("\n\nb", "\n\nb")],
)
def test_notes_end_at_a_blank_line(spark, text, want):
    assert one(spark, T.note_free("t"), t=text) == want


def test_slug_and_type_name(spark):
    rows = spark.createDataFrame([("Été & Co", "SectionType.record-form"), ("***", " scope ")], "t string, k string")
    got = rows.select(T.slug("t", 3), T.type_name("k")).collect()
    assert [tuple(r) for r in got] == [("section_ete_co_3", "RECORD_FORM"), ("section_section_3_3", "SCOPE")]


def test_obligations_count_items(spark):
    assert one(spark, T.obligations("t"), t="It shall:\na) x\nb) y\nc) z") == 3 and one(spark, T.obligations("t"), t="It shall and must.") == 2 and one(spark, T.obligations("t"), t="a) x") == 0


def test_inputs_are_checked(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        sources.check_input(spark, str(tmp_path / "none.pdf"))
    with pytest.raises(ValueError):
        sources.check_input(spark, str(tmp_path / "a.txt"))


def test_decoding_reports_errors(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    rows = sources.decoded(sources.read_files(spark, str(tmp_path)), lambda path, content: [("d", 1, 0, "body", content.decode())])
    report = sources.batch_report(rows).collect()
    assert [(r["path"][-5:], r["status"], r["rows"]) for r in report] == [("a.pdf", "ok", 1), ("b.pdf", "error", 0)] and "Unicode" in report[1]["error"]


def test_pages_of_items(spark):
    rows = spark.createDataFrame([("a", 2, 0, "z"), ("a", 1, 1, "y"), ("a", 1, 0, "x"), ("b", 1, 0, "p\fq"), ("c", None, 0, "r")], "doc string, page int, pos int, text string")
    assert {r["doc"]: r["page_texts"] for r in sources.item_pages(rows).collect()} == {"a": ["x\ny", "z"], "b": ["p", "q"], "c": ["r"]}


def test_collections_are_upserted_and_guarded(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v int")
    folder = str(tmp_path / "c")
    assert sources.write_collection(rows(("a", 1), ("b", 1)), folder, "id", "m", 8).count() == 2
    for _ in range(2):
        got = sources.write_collection(rows(("b", 2), ("c", 2)), folder, "id", "m", 8)
        assert {r["id"]: r["v"] for r in got.collect()} == {"a": 1, "b": 2, "c": 2}
    with pytest.raises(RuntimeError):
        sources.write_collection(rows(("a", 1)), folder, "id", "other", 8)


def test_retries_and_fallback():
    calls = []

    class Busy(Exception):
        def __init__(self, status):
            self.status = status

    def flaky(x):
        calls.append(x)
        raise Busy(429 if len(calls) < 3 else 400)

    with pytest.raises(Busy):
        hooks.retried(flaky, tries=5, wait=0)("x")
    assert len(calls) == 3  # too many requests are tried again, a bad request isn't
    local = hooks.with_fallback(lambda t: 1 / 0, lambda t: [[1.0] for _ in t])
    assert local(["a", "b"]) == [[1.0], [1.0]] and hooks.with_fallback(lambda t: [[2.0]], lambda t: None)(["a"]) == [[2.0]]


SECTIONS = "doc string, section_id string, section_type string, title string, raw_text string"


def test_audit_applies_usable_answers(spark):
    rows = spark.createDataFrame([(d, s, "scope", "t", "x" * 400) for d in ("a", "b", "c", "e") for s in ("1", "2")], SECTIONS)

    def ask(prompt):
        shown = json.loads(prompt[prompt.index("\n") + 1 :])
        assert len(shown) == 2 and all(len(x["preview"]) == 300 for x in shown)
        return json.dumps([{"id": x["id"], "valid": x["id"] == "1", "clause_family": "99" if x["id"] == "2" else "8"} for x in shown] + [{"id": 5}, {"valid": True}])

    got = {(r["doc"], r["section_id"]): (r["llm_valid"], r["predicted_clause_family"], r["kept"]) for r in plans.audit(rows, "doc", ask).collect()}
    assert got["a", "1"] == (True, "8", True) and got["b", "2"] == (False, None, False) and len(got) == 8
    nothing = plans.audit(rows, "doc", lambda p: "sorry").collect()
    assert all(r["kept"] and r["llm_valid"] is None for r in nothing)
    none = plans.audit(rows, "doc", lambda p: json.dumps([{"id": x, "valid": False} for x in "12"])).collect()
    assert all(r["kept"] and r["llm_valid"] is None for r in none)


def test_records_take_defaults(spark):
    rows = spark.createDataFrame([(1, '{"section_id":"s","section_type":"odd","page_start":"x","page_end":"4","extraction_confidence":null}'), (2, None), (3, "no json")], "n int, payload string")
    got = {r["n"]: r for r in ingest.section_records(rows).collect()}
    assert (got[1]["section_type"], got[1]["page_start"], got[1]["page_end"], got[1]["heading_level"], got[1]["extraction_confidence"]) == ("unknown", 0, 4, 1, 0.0)
    assert got[2]["section_id"] == got[3]["title"] == ""


def test_vectors_of_another_size_are_refused(spark):
    rows = spark.createDataFrame([([0.0] * 3,), (None,)], "embedding array<double>")
    assert ingest.check_vectors(rows, size=3).count() == 2
    with pytest.raises(ingest.IngestionError):
        ingest.check_vectors(rows, size=4)


def test_gate_counts_every_fate(spark):
    rows = spark.createDataFrame([("a", "x" * 50, 0.5), ("a", "y" * 50, 0.9), ("a", "z" * 50, None), ("a", "", 1.0), ("b", "", 1.0), ("b", None, 1.0)], "doc string, raw_text string, extraction_confidence double")
    got = {r["doc"]: r for r in ingest.counters(ingest.gated(rows, "doc"), "doc").collect()}
    assert (got["a"]["ingested"], got["a"]["skipped_low_confidence"], got["a"]["skipped_empty_text"], got["a"]["reason"]) == (1, 2, 1, None)
    assert (got["b"]["skipped_quality_gate"], got["b"]["reason"]) == (2, "low_quality_document")
    assert ingest.counters(ingest.gated(rows.limit(0), "doc"), "doc").count() == 0


def test_repeated_lines_and_rules_beside_them(spark):
    body = [f"line {chr(97 + i)} of the text" for i in range(18)]
    text = "\n".join(["Code | FO-12", "---", *body[:9], "Code | FO-13", *body[9:], "--- ---"])
    lines = pages.text_lines(spark.createDataFrame([("d", text), ("e", "Code | a1\nCode | a1"), ("f", None)], "doc string, text string"), "doc", "text")
    got = [(r["line"], r["fate"]) for r in pages.repeated_signatures(lines, "doc").filter("fate is not null").orderBy("pos").collect()]
    assert got == [("Code | FO-12", "repeated"), ("---", "separator"), ("Code | FO-13", "repeated")]


def test_zones_have_three_states(spark):
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(["Annex 0", "1 Scope", "text", "Annex A", "end"])] + [("e", 0, "text")], "doc string, pos int, line string")
    assert [r["zone"] for r in pages.zones(lines).orderBy("doc", "pos").collect()] == ["front", "clauses", "clauses", "back", "back", "front"]


def test_blocks_become_text_and_lines(spark):
    rows = spark.sql("select array(array(struct('a\\b' as text, 9.0D as size), struct('b ' as text, 12.04D as size)), array(struct(' ' as text, 30.0D as size))) as lines")
    assert rows.select(layout.block_text(F.col("lines")), layout.dominant_size(F.col("lines"))).first()[:] == ("ab", 12.0)
    line = lambda t, n: one(spark, layout.block_markdown(F.col("t"), F.col("n"), F.array(F.lit("foot"))), t=t, n=n)
    assert (line("Scope", 2), line("foot", 0), line("vi\nfoot", 0), line("a\nfoot", 0), line("", 1)) == ("## Scope", None, None, "a", None)


def test_preambles_take_their_fields(spark):
    f = lambda body, kind: one(spark, segment.promote_fields(F.col("b"), F.lit(kind), F.create_map(F.lit("code"), F.lit("X"))), b=body)
    assert (f("head", "metadata"), f("head", "scope"), f("a code: X", "metadata")) == ("head\n\ncode: X", "head", "a code: X")


def test_scoped_vocabulary(spark):
    vocabulary = spark.createDataFrame([("top management", ["N1"], "senior management"), ("top management", ["N1"], "top management"), ("hazard", ["N2"], "hazard")], "canonical string, standards array<string>, form string")
    texts = spark.createDataFrame([(1, "Senior management sees a hazard", ["N1"]), (2, "hazard", ["N1"]), (3, "Top management: hazard", []), (4, None, None)], "id int, t string, scope array<string>")
    got = sorted(map(tuple, corpus.scoped_hits(texts, "id", "t", vocabulary, "scope").collect()))
    assert got == [(1, "top management"), (3, "hazard"), (3, "top management")]
    asked = texts.select(F.col("id").alias("query_id"), F.coalesce("t", F.lit("")).alias("query"), F.lit("EN").alias("language"), F.col("scope").alias("norms"), F.array(F.lit("8.5")).alias("specific"))
    out = {r["query_id"]: r for r in retrieval.transform_queries(asked, vocabulary).collect()}
    assert out[1]["tokens"] == ["5", "8", "hazard", "management", "sees", "senior", "top"] and out[1]["embed_text"].startswith("search_query: ") and out[4]["hits"] == []


def test_lookup_and_delete(spark):
    rows, ids = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, v string"), spark.createDataFrame([(2,), (2,), (None,)], "id int")
    assert [r["v"] for r in registry.lookup(rows, ids, "id").collect()] == ["b"] and sorted(r["v"] for r in registry.delete_points(rows, ids, "id").collect()) == ["a", "c"]


def test_lists_merge_by_score(spark):
    a, b = (spark.createDataFrame(x, "query_id int, id int, score double") for x in ([(1, 1, 0.9), (1, 2, 0.1)], [(1, 2, 0.8), (1, 3, 0.2)]))
    assert [(r["id"], r["rank"]) for r in retrieval.merge_by_score([a, b], "id", 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
