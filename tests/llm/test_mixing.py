import random

import pytest

from clauseworks.llm import mixing as M


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


def targets(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "source string, target_share double, max_repeats int, tokens int")


@pytest.mark.parametrize("width", [500_000, 100])
def test_shares_and_repeats(spark, monkeypatch, width):
    monkeypatch.setattr(M, "RANGE", width)
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "a", "b", "c"]), rng.randint(1, 60)) for i in range(3000)] + [(9000, "a", 20_000)]
    mixture, plan = M.mix(sizes(spark, rows), targets(spark, [("A", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.0, 2)]))
    got = mixture.collect()
    share = {r["source"]: r for r in M.shares(mixture, plan).collect()}
    assert all(abs(share[s]["actual_share"] - w) < 0.005 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    assert all(r["copies"] <= share[r["source"]]["max_repeats"] for r in got) and len({r["doc_id"] for r in got}) == len(got)
    budget = {r["source"]: r["budget"] for r in plan.collect()}
    assert all(share[s]["tokens"] <= budget[s] for s in "abc")


def test_smaller_total_and_missing_sources(spark):
    rows = [(i, "a", 10) for i in range(100)] + [(200 + i, None, 10) for i in range(5)] + [(300, "b", 0)]
    mixture, plan = M.mix(sizes(spark, rows), targets(spark, [("a", 0.6, 1), ("b", 0.4, 9)]), total=500)
    assert sum(r["tokens"] * r["copies"] for r in mixture.collect()) == 300
    share = {r["source"]: r["actual_share"] for r in M.shares(mixture, plan).collect()}
    assert share == {"a": 1.0, "b": 0.0}


def test_empty(spark):
    mixture, plan = M.mix(sizes(spark, []), targets(spark, [("a", 1.0, 1)]))
    assert mixture.count() == 0 and M.shares(mixture, plan).first()["actual_share"] == 0
    assert M.mix(sizes(spark, [(1, "a", 5)]), targets(spark, []))[0].count() == 0
