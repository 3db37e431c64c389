import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clauseworks.llm import packing as P
from clauseworks.llm import tokens


def place(plan, histogram):
    """Containers (list of sizes) of a plan; every rank must be placed once."""
    containers, seen = defaultdict(list), Counter()
    for size, a, z, first, each in plan:
        for rank in range(a, z):
            containers[first + (rank - a) // each].append(size)
            seen[size] += 1
    assert seen == Counter({s: n for s, n in histogram.items() if n})
    return containers


def one_by_one(histogram, capacity):
    """Plain best fit decreasing: its number of containers."""
    gaps = []
    for size in sorted((s for s in histogram.elements() if s), reverse=True):
        fit = [g for g in gaps if g >= size]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - size)
        else:
            gaps.append(capacity - size)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=120))
def test_plan_equals_best_fit_one_by_one(sizes):
    histogram = Counter(sizes)
    containers = place(P.best_fit(histogram, 40), histogram)
    assert all(sum(c) <= 40 for c in containers.values())
    used = {k for k, c in containers.items() if sum(c)}
    assert len(used) == one_by_one(histogram, 40) and used == set(range(len(used)))


def test_pack_in_spark(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET", 50)
    rng = random.Random(4)
    sizes = {i: rng.choice([0, 5, 5, 5, 17, 40, 95, 230]) for i in range(400)}
    rows = spark.createDataFrame(list(sizes.items()), "doc_id long, tokens long")
    got = P.pack(rows, 100).collect()
    load, pieces = Counter(), defaultdict(list)
    for r in got:
        load[r["container_no"]] += r["tokens"]
        pieces[r["doc_id"]].append((r["piece_no"], r["tokens"]))
    assert max(load.values()) <= 100 and {d: sum(t for _, t in p) for d, p in pieces.items()} == sizes
    assert all(len(p) == max(1, -(-sizes[d] // 100)) and len(set(p)) == len(p) for d, p in pieces.items())
    assert len(load) <= 1.05 * sum(sizes.values()) / 100 + 1


def test_empty_and_only_blank(spark):
    none = spark.createDataFrame([], "doc_id long, tokens long")
    specs = spark.createDataFrame([(1, 10, 3), (1, 10, 3), (2, 0, 3)], "spec_id int, capacity_tokens int, tokens int")
    assert P.pack_all(none, specs).count() == 0
    blank = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, tokens long")
    assert {r["container_no"] for r in P.pack_all(blank, specs).collect()} == {0}
    assert P.fill(P.pack_all(blank, specs), specs).first()["containers"] == 1
    assert P.pack_all(blank, specs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["The pump isn't on.", "é à ü 1234  \n\n x", "", "<|endoftext|>"])
def test_counts_are_the_tokenizers(documents, text):
    rows = documents([(1, text, " Site-Wiki "), (2, None, None), (1, text, "site wiki"), (None, "x", "a")])
    got = {r["doc_id"]: (r["source"], r["tokens"]) for r in tokens.token_counts(rows).collect()}
    assert got == {1: ("site_wiki", len(tokens.encoding().encode_ordinary(text))), 2: (None, 0)}
    assert tokens.encoding().decode(tokens.encoding().encode_ordinary(text)) == text
