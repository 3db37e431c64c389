"""Every query of the subpackage on the smallest tables, and on empty ones."""

import pytest

from clauseworks.llm import catalog

from oracle import difference

SMALL = "/root/testdata/sf0.001"
TABLES = "iso_norms iso_clauses keyword_registry term_probes parsed_sections parsed_documents documents source_targets container_specs".split()


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_runs_and_repeats(spark, name):
    run = catalog.queries()[name]
    first = run(spark, SMALL)
    rows = sorted(map(repr, first.collect()))
    assert rows and len(rows) == len(set(rows))
    assert rows == sorted(map(repr, run(spark, SMALL).collect()))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_empty_tables(spark, empty, name):
    assert catalog.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_its_sql(spark, name):
    assert difference(spark, SMALL, catalog.queries()[name], catalog.oracle_sql()[name]) is None
