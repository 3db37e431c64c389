import pytest

from clauseworks import catalog

from oracle import difference

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_its_sql(spark, name):
    sql = catalog.oracle_sql().get(name)
    run = catalog.queries()[name]
    if sql is None:
        assert run(spark, SMALL).columns
    else:
        assert difference(spark, SMALL, run, sql) is None


def test_deliveries_and_rules_are_whole(spark):
    run = lambda name: catalog.queries()[name](spark, SMALL)
    read = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
    assert run("merged_tables").select("id").exceptAll(read("documents").select("doc_id")).isEmpty()
    assert run("merged_tables").count() == read("documents").count() and run("merged_tables").filter("src = 2").count() == read("documents").filter("lang is not null").count()
    assert run("replaced_norms").groupBy().sum("n").first()[0] == read("iso_clauses").select("clause_uid").distinct().count()
    assert run("filtered_clauses").select("norm_id").distinct().count() > 0
    assert {r["rule"] for r in run("chunk_violations").select("rule").distinct().collect()} >= {"requirement_without_shall"}
