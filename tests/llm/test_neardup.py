import itertools
import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from clauseworks.llm import neardup as N


def word_sets(text):
    w = N._WORD.findall((text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= N.LEAST_WORDS else None


def brute(rows):
    """All pairs of at least half their union, by a matrix of records and sequences."""
    sets = {u: word_sets(t) for u, t in rows if u is not None}
    uids = sorted(u for u, s in sets.items() if s)
    place = {g: i for i, g in enumerate(sorted(set().union(*(sets[u] for u in uids))))}
    x = np.zeros((len(uids), len(place)), np.float32)
    for i, u in enumerate(uids):
        x[i, [place[g] for g in sets[u]]] = 1
    common, size = x @ x.T, x.sum(1)
    a, b = np.nonzero(np.triu(common >= 0.5 * (size[:, None] + size[None, :] - common), 1))
    return {(uids[i], uids[j]) for i, j in zip(a, b)}


def corpus(seed=5, base=60):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows, uid = [], 1
    for _ in range(base):
        words = rng.choices(vocabulary, k=rng.randint(30, 160))
        rows.append((uid, " ".join(words)))
        uid += 1
        for _ in range(rng.randint(0, 3)):
            other = list(words)
            for _ in range(rng.randint(0, max(1, len(other) // 12))):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rows.append((uid, " ".join(other)))
            uid += 1
    return rows


def records(spark, rows, kind="section"):
    return spark.createDataFrame([(kind, u, t, 0) for u, t in rows], "record_kind string, record_uid long, text string, rep int")


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    got = {(r["uid_a"], r["uid_b"]) for r in N.similar_pairs(records(spark, rows + rows[:5] + [(None, rows[0][1]), (9999, None), (9998, "")])).collect()}
    want = brute(rows)
    assert len(want) > 50 and got <= want and len(got) >= 0.97 * len(want)


def test_kinds_never_mix(spark):
    rows = [(1, "alpha beta gamma delta " * 15)]
    both = records(spark, rows).unionByName(records(spark, [(2, rows[0][1])], "clause"))
    assert N.similar_pairs(both).count() == 0


def pairs(spark, rows):
    return {(r["uid_a"], r["uid_b"]) for r in N.similar_pairs(records(spark, rows)).collect()}


def test_copies_are_classes(spark, monkeypatch):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, words) for i in range(1, 301)] + [(400, words + " more")]
    groups = N.groups(records(spark, rows)).collect()
    assert len(groups) == 301 and {r["group_uid"] for r in groups} == {1}
    assert len(pairs(spark, rows)) == 301 * 300 // 2
    (link,) = N.representative_links(records(spark, rows)).collect()
    assert (link["uid_a"], link["uid_b"], link["n_a"], link["n_b"]) == (1, 400, 300, 1)


def test_large_classes_keep_their_links(spark, monkeypatch):
    monkeypatch.setattr(N, "COPIES", 100)  # beyond it copies are linked with the first of them, and with all that is similar to it
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, words) for i in range(1, 301)] + [(400, words + " more")]
    assert pairs(spark, rows) == {(1, i) for i in range(2, 301)} | {(i, 400) for i in range(1, 301)}
    rows = [(i, words) for i in range(1, 121)] + [(i, words + " more") for i in range(201, 331)]
    stars = {(1, i) for i in range(2, 121)} | {(201, i) for i in range(202, 331)}
    assert pairs(spark, rows) == stars | {(i, 201) for i in range(1, 121)} | {(1, i) for i in range(201, 331)}


def test_hot_classes_meet_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 10)
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, words) for i in range(1, 31)] + [(i, words + " more and more") for i in (40, 41)] + [(1, words)]
    assert len(pairs(spark, rows)) == 32 * 31 // 2


def test_crowded_region_loses_nothing(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for u in range(1, 151):
        other = list(words)
        other[rng.randrange(400)] = f"x{u}"
        rows.append((u, " ".join(other)))
    got = {(r["uid_a"], r["uid_b"]) for r in N.similar_pairs(records(spark, rows)).collect()}
    assert got == brute(rows) and len(got) == 150 * 149 // 2


def test_keys_hold_tree_prefix_and_sketch():
    m = np.arange(3 * N.HASHES, dtype=np.uint32).reshape(3, -1)
    m[1] = m[0]
    s1, s2, s3 = N.sketches(m)
    keys = N.tree_keys(m)
    assert (keys[0] == keys[1]).all() and (keys[0] != keys[2]).all() and keys.max() < 1 << N.PREFIX and s3.max() < 1 << N.REST
    raw = [k.view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for k in keys]
    (rows,) = N._spread([pa.RecordBatch.from_arrays([pa.array([2, 4, 6]), pa.array(s1), pa.array(s2), pa.array(s3), pa.array(raw, pa.binary())], list("abcde"))])
    key = rows.column(0).to_numpy().reshape(3, N.TREES).astype(np.uint64)
    assert (key >> np.uint64(N.REST) & np.uint64((1 << N.PREFIX) - 1) == keys).all() and (key[2] & np.uint64((1 << N.REST) - 1) == s3[2]).all()
    assert N._agreement((key[:1, 0].astype(np.int64), s1[:1], s2[:1]), (key[1:2, 0].astype(np.int64), s1[1:2], s2[1:2]))[0] == N.HASHES


def family(n=300, length=300, changed=0.057, seed=8):
    """Texts of one origin; two of them have about half of their sequences in common."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(length)]
    return [(u, " ".join(f"x{u}y{i}" if rng.random() < changed else w for i, w in enumerate(words))) for u in range(1, n + 1)]


def test_large_family_near_the_limit(spark):
    rows = family()
    got = {(r["uid_a"], r["uid_b"]) for r in N.similar_pairs(records(spark, rows)).collect()}
    want = brute(rows)
    print("recall", len(got & want) / len(want), len(want))
    assert len(want) > 20000 and got <= want and len(got) >= 0.985 * len(want)


@pytest.mark.parametrize("n,changed", [(50, 8), (200, 6), (500, 8), (1000, 6)])
def test_dense_families(spark, n, changed):
    """Variants of one text of 120 words, each with some words changed."""
    rng = random.Random(n + changed)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for u in range(1, n + 1):
        other = list(words)
        for i in rng.sample(range(120), changed):
            other[i] = f"x{u}y{i}"
        rows.append((u, " ".join(other)))
    got, want = pairs(spark, rows), brute(rows)
    print(n, changed, len(want), len(got) / len(want))
    assert len(want) > 20 and got <= want and len(got) >= 0.97 * len(want)


def sweep(regions, tasks):
    """The blocks that some tasks make of rows (key, packed), which they hold in order."""
    out = []
    for rows in tasks:
        key = np.array([regions[u] << N.REST for u in rows], np.int64)
        batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array([2 * u for u in rows], pa.int64()), *[pa.array([5] * len(rows), pa.int64())] * 2], ["key", "packed", "s1", "s2"])
        out += [r for b in N._sweep(iter([batch.slice(a, 7) for a in range(0, len(rows), 7)])) for r in b.to_pylist()]
    return out


def test_regions_over_several_tasks_meet(spark, monkeypatch):
    """A region that a task's edge, DIRECT or OPEN parts is compared whole, every pair once."""
    monkeypatch.setattr(N, "DIRECT", 20)
    monkeypatch.setattr(N, "OPEN", 30)
    monkeypatch.setattr(N, "BLOCK", 8)
    regions = {u: 1 if u < 5 else 2 if u < 75 else 3 if u < 80 else 4 if u < 105 else 5 for u in range(110)}
    rows = sweep(regions, [range(0, 40), range(40, 90), range(90, 110)])
    direct = [(r["a"], r["b"]) for r in rows if r["a"] is not None]
    found = spark.createDataFrame([r for r in rows], N.PAIRS)
    pairs = direct + [(r["a"], r["b"]) for r in N.crowded_pairs(found).collect()]
    assert sorted(pairs) == [(a, b) for a, b in itertools.combinations(range(110), 2) if regions[a] == regions[b]]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(1, 40)] + [(1, 7, 9)], "kind int, a long, b long")
    got = {(r["kind"], r["uid"]): r["root"] for r in N.components(edges).collect()}
    assert {got[0, i] for i in range(1, 41)} == {1} and got[1, 9] == 7


def test_empty(spark):
    assert N.similar_pairs(records(spark, [])).count() == 0 and N.groups(records(spark, [(1, None)])).count() == 0


def phrases(n=600, seed=4):
    """Texts of phrases that many have in common; two of them have about a sixth of their sequences in common."""
    rng = random.Random(seed)
    pool = [" ".join(f"p{i}w{k}" for k in range(5)) for i in range(90)]
    return [(u, " ".join(rng.sample(pool, 40))) for u in range(1, n + 1)]


def test_chance_meetings_are_not_written(spark, monkeypatch):
    """Of texts that only share phrases few pairs reach the disk, and what the steps wrote goes with them."""
    settled, written, real = [], [], N.settle

    def settle(df, name):
        out = real(df, name)
        settled.append((name, out.inputFiles()))
        if name == "forest":
            written.append(out.filter("a is not null").count())
        return out

    monkeypatch.setattr(N, "settle", settle)
    rows = phrases()
    assert pairs(spark, rows) == brute(rows)
    print("pairs written", sum(written))
    assert sum(written) < 500
    assert {name for name, files in settled if any(Path(f.removeprefix("file://")).exists() for f in files)} <= {"twins", "candidates", "links"}


def test_shuffle_files_go_with_their_query(spark):
    from clauseworks.runtime import shuffles_freed

    dirs = [Path(str(d)) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for f in d.rglob("shuffle_*.data")}
    before = files()
    with shuffles_freed(spark):
        spark.range(10_000).repartition(3).write.format("noop").mode("overwrite").save()
        for _ in range(100):
            if files() <= before:
                break
            time.sleep(0.1)
    assert files() <= before
    kept = spark.range(10_000).repartition(3).write.format("noop").mode("overwrite").save
    kept()
    assert files() - before  # they stay without it


def test_portions_change_nothing(spark, monkeypatch):
    rows = corpus()
    whole = pairs(spark, rows)
    monkeypatch.setattr(N, "PORTION", 1)
    assert len(whole) > 50 and pairs(spark, rows) == whole
    monkeypatch.setattr(N, "BROADCAST_IDS", 0)
    assert pairs(spark, rows) == whole


def test_bitmaps_never_lose_a_common_element():
    rng = np.random.default_rng(6)
    for m, n, common in [(40, 40, 0), (40, 40, 40), (60, 900, 50), (900, 60, 30), (5000, 4000, 2000), (5000, 40, 40), (100, 100, 50)]:
        x = rng.integers(0, 1 << 63, m + n - common, dtype=np.uint64)
        one, other = N.bitmaps([np.sort(x[:m]), np.sort(x[m - common :])])
        most = N.most_common(one, other, m, n)
        assert common <= most <= min(m, n) and (m != n or most < common + m // 4)
