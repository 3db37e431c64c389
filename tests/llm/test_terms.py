import numpy as np

from clauseworks.llm import terms as M


def brute(uses, p, own=M.OWN):
    q = [u / sum(uses) for u in uses]
    for _ in range(M.ROUNDS):
        e = [u * own * x / ((1 - own) * y + own * x) for u, x, y in zip(uses, q, p)]
        q = [x / sum(e) for x in e]
    return q


def test_batches_equal_single_records():
    rng = np.random.default_rng(1)
    records = [(rng.integers(1, 9, n).astype(float), rng.random(n) / 50) for n in (1, 5, 30)]
    starts = np.cumsum([0] + [len(u) for u, _ in records])[:-1]
    got = M.separate(np.concatenate([u for u, _ in records]), np.concatenate([p for _, p in records]), starts)
    want = np.concatenate([brute(u.tolist(), p.tolist()) for u, p in records])
    assert np.allclose(got, want, atol=1e-5)


def data(spark, clauses):
    rows = [(i, "EN", "the pump and the tank and the line " * 3) for i in range(30)] + [(40, "EN", "the Zorbin pump zorbin and the tank zorbin lone"), (41, "EN", "zorbin and the line"), (40, "EN", "the Zorbin pump zorbin and the tank zorbin lone"), (42, "EN", None), (43, "EN", "")]
    registry = spark.createDataFrame([(1, ["Risk Plan", "audit"]), (2, ["risk plan", None, "records"]), (3, ["records", "audit"]), (4, None), (5, []), (6, ["records"])], "entry_id long, keywords array<string>")
    return M.records(clauses(rows), registry)


def test_probes(spark, clauses):
    rows = data(spark, clauses)
    probes = spark.createDataFrame([(1, "clause", 40, ["pump", "zorbin", "lone"]), (2, "registry", 1, ["risk plan", "audit"]), (3, "clause", 42, ["x"]), (4, "registry", None, ["x"])], "probe_id long, record_kind string, record_uid long, candidates array<string>")
    scored = M.score_terms(M.only_probed(rows, probes), M.background(rows))
    got = {r["probe_id"]: r["term"] for r in M.answer_probes(scored, probes).collect()}
    assert got[1] == "zorbin" and got[2] in ("risk plan", "audit") and set(got) == {1, 2}


def test_joined_background_gives_the_same(spark, clauses):
    rows = data(spark, clauses).dropDuplicates(["record_kind", "record_uid"])
    known = M.background(rows)
    as_set = lambda df: {(r["record_kind"], r["record_uid"], t["term"], t["score"]) for r in df.collect() for t in r["terms"]}
    assert as_set(M.score_terms(rows, known)) == as_set(M.score_terms(rows, known, limit=0)) != set()


def test_empty(spark, clauses):
    rows = data(spark, clauses).limit(0)
    assert M.score_terms(rows, M.background(rows)).count() == 0
