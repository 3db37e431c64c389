"""Problem 2: how characteristic a term is of its record.

Method: parsimonious language models. Expectation-maximisation splits the terms of each record between the record's own model and
the background of all records of its table; what the background explains loses its mass, and the converged probabilities rank
the terms. Background counts cover all records.

The background is broadcast where its size is within BROADCAST_TERMS; beyond, the terms above a share of all tokens are (at most
1 / SHARE of them, so no join key is hot) and the rest are joined. Terms are compared in lower case: of a clause its runs of
letters, of an entry its whole keywords. Null and empty records have no terms; a record delivered again counts once; equal scores
rank the rarer, then the alphabetically first term higher.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import over_batches, settle

#: Weight of the record's own model in a token; small, so that a word used everywhere needs many uses to stand out.
OWN = 0.005
ROUNDS, CLOSE = 80, 1e-7
BROADCAST_TERMS = 300_000
SHARE = 1e-5
LETTERS = re.compile(r"[^\W\d_]+")


def records(clauses: DataFrame, registry: DataFrame) -> DataFrame:
    """record_kind, record_uid, text, keywords of both tables."""
    c = clauses.select(F.lit("clause").alias("record_kind"), F.col("clause_uid").alias("record_uid"), "text", F.lit(None).cast("array<string>").alias("keywords"))
    return c.unionByName(registry.select(F.lit("registry").alias("record_kind"), F.col("entry_id").alias("record_uid"), F.lit(None).cast("string").alias("text"), "keywords")).filter("record_uid is not null")


def terms_of(text: str | None, keywords: list | None) -> Counter:
    if text is not None:
        return Counter(LETTERS.findall(text.lower()))
    return Counter(w for w in (k.strip().lower() for k in keywords or () if k) if w)


def _tally(batches):
    seen = set()  # a record's deliveries lie in one partition
    count, held, total = Counter(), Counter(), Counter()

    def flush():
        keys = list(held)
        kinds, words = (list(x) for x in zip(*keys)) if keys else ([], [])
        out = pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(words, pa.string()), pa.array([count[k] for k in keys], pa.int64()), pa.array([held[k] for k in keys], pa.int64())], ["record_kind", "term", "uses", "holders"])
        count.clear()
        held.clear()
        return out

    for b in batches:
        for kind, uid, text, keywords in zip(*(b.column(i).to_pylist() for i in range(4))):
            if uid is None or (kind, uid) in seen:
                continue
            seen.add((kind, uid))
            for w, n in terms_of(text, keywords).items():
                count[kind, w] += n
                held[kind, w] += 1
        if len(held) > 500_000:
            yield flush()
    yield flush()


def background(rows: DataFrame) -> DataFrame:
    """record_kind, term, uses, holders, p over all records."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = over_batches(rows.repartition(n, "record_kind", "record_uid"), _tally, "record_kind string, term string, uses long, holders long")
    terms = settle(parts.groupBy("record_kind", "term").agg(F.sum("uses").alias("uses"), F.sum("holders").alias("holders")), "background")
    total = terms.groupBy("record_kind").agg(F.sum("uses").alias("total"))
    return terms.join(F.broadcast(total), "record_kind").select("record_kind", "term", "uses", "holders", (F.col("uses") / F.col("total")).alias("p"))  # one row a kind


def separate(uses: np.ndarray, p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Converged own probabilities of the terms of many records; record i has the terms from starts[i] to the next start."""
    if not len(uses):
        return np.zeros(0)
    size = np.diff(np.append(starts, len(uses)))
    own = uses / np.repeat(np.add.reduceat(uses, starts), size)
    for _ in range(ROUNDS):
        e = uses * (OWN * own / ((1 - OWN) * p + OWN * own))
        new = e / np.repeat(np.maximum(np.add.reduceat(e, starts), 1e-300), size)
        done = np.abs(new - own).max() < CLOSE
        own = new
        if done:
            break
    return own


TERMS = "array<struct<term:string,uses:long,holders:long,score:double>>"
_ARROW = pa.list_(pa.struct([("term", pa.string()), ("uses", pa.int64()), ("holders", pa.int64()), ("score", pa.float64())]))


def _ranked(kinds, uids, found: list[list[tuple[str, int, int, float]]]) -> pa.RecordBatch:
    """found: of each record its (term, uses, holders, p)."""
    live = [i for i, x in enumerate(found) if x]
    flat = [t for i in live for t in found[i]]
    starts = np.cumsum([0, *(len(found[i]) for i in live)])[:-1]
    own = separate(np.array([t[1] for t in flat], float), np.array([t[3] for t in flat]), starts.astype(np.int64))
    terms: list[list] = [[] for _ in found]
    for i, a in zip(live, starts):
        terms[i] = sorted(({"term": t[0], "uses": t[1], "holders": t[2], "score": round(float(s), 9)} for t, s in zip(found[i], own[a : a + len(found[i])])), key=lambda x: (-x["score"], x["holders"], x["term"]))
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(uids, pa.int64()), pa.array(terms, _ARROW)], ["record_kind", "record_uid", "terms"])


def score_terms(rows: DataFrame, known: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    """record_kind, record_uid, terms (best first) of rows(record_kind, record_uid, text, keywords) against the background."""
    spark = rows.sparkSession
    n = known.count()
    common = known if n <= limit else known.filter(F.col("p") >= SHARE)
    table = {(r["record_kind"], r["term"]): (r["holders"], r["p"]) for r in common.select("record_kind", "term", "holders", "p").toLocalIterator()}
    shared = spark.sparkContext.broadcast(table)
    schema = f"record_kind string, record_uid long, terms {TERMS}"

    if n <= limit:

        def direct(batches):
            got = shared.value
            for b in batches:
                kinds, uids, texts, keywords = (b.column(i).to_pylist() for i in range(4))
                found = [[(w, c, *got[k, w]) for w, c in terms_of(t, x).items() if (k, w) in got] for k, t, x in zip(kinds, texts, keywords)]
                yield _ranked(kinds, uids, found)

        return over_batches(rows, direct, schema)

    def explode(batches):
        got = shared.value
        names = ["record_kind", "record_uid", "term", "uses", "holders", "p"]
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
        for b in batches:
            out = [(k, u, w, c, *got.get((k, w), (None, None))) for k, u, t, x in zip(*(b.column(i).to_pylist() for i in range(4))) for w, c in terms_of(t, x).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names)

    long = over_batches(rows, explode, "record_kind string, record_uid long, term string, uses long, holders long, p double")
    rare = long.filter("p is null").drop("holders", "p").join(known.select("record_kind", "term", "holders", "p"), ["record_kind", "term"])
    cols = ["record_kind", "record_uid", "term", "uses", "holders", "p"]
    grouped = long.filter("p is not null").select(cols).unionByName(rare.select(cols)).groupBy("record_kind", "record_uid").agg(F.collect_list(F.struct("term", "uses", "holders", "p")).alias("terms"))

    def regroup(batches):
        for b in batches:
            found = [[(t["term"], t["uses"], t["holders"], t["p"]) for t in x] for x in b.column(2).to_pylist()]
            yield _ranked(b.column(0).to_pylist(), b.column(1).to_pylist(), found)

    return over_batches(grouped, regroup, schema)


def answer_probes(scored: DataFrame, probes: DataFrame) -> DataFrame:
    """probe_id, term: of each probe the candidate with the highest score among those that another record holds, too."""
    asked = probes.select("probe_id", "record_kind", "record_uid", F.transform("candidates", F.lower).alias("candidates"))
    fit = F.filter("terms", lambda t: F.array_contains("candidates", t["term"]) & (t["holders"] >= 2))
    return asked.join(scored, ["record_kind", "record_uid"]).select("probe_id", F.get(fit, F.lit(0))["term"].alias("term")).filter("term is not null").distinct()


def only_probed(rows: DataFrame, probes: DataFrame) -> DataFrame:
    return rows.join(probes.select("record_kind", "record_uid").distinct(), ["record_kind", "record_uid"], "left_semi").dropDuplicates(["record_kind", "record_uid"])
