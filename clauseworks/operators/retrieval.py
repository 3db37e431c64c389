"""Filtered dense and sparse top-k, rank fusion, reranking, evaluation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..runtime import BROADCAST_LIMIT, over_batches

RRF_K = 60
#: Queries scored at once against a batch of rows.
BLOCK = 512


class EmptyCorpusError(RuntimeError):
    """The filter of a retrieval leaves nothing."""


def norm_filter(norms: Sequence[str], language: str | None = None, families: Sequence[str] = ()) -> Column:
    """Conjunctive predicate on norm_id, language and top_level_family; it is pushed to the scan. No norms is an error."""
    if not norms:
        raise ValueError("at least one norm is needed")
    out = F.col("norm_id").isin(list(norms))
    if language:
        out &= F.col("language") == language
    return out & F.col("top_level_family").isin(list(families)) if families else out


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, score, rank: exact cosine neighbours of every query(query_id, vector).

    Queries are taken to the rows in blocks whose size is checked, every task keeps its k best of each query, and the partial lists
    are merged; rows are never shuffled. Null and zero vectors have no neighbours.
    """
    spark = vectors.sparkSession
    taken = queries.select("query_id", vector).filter(F.col(vector).isNotNull())
    width = taken.select(F.max(F.size(vector))).first()[0] or 0
    count = taken.count()
    per_round = max(1, BROADCAST_LIMIT // max(8, 8 * width))
    rounds = -(-count // per_round) or 1
    out = None
    for r in range(rounds):
        part = taken if rounds == 1 else taken.filter(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r)
        rows = part.toPandas()  # at most about BROADCAST_LIMIT bytes
        ids = rows["query_id"].to_numpy(np.int64)
        matrix = np.array(rows[vector].tolist(), np.float64).reshape(len(ids), -1)
        norms = np.linalg.norm(matrix, axis=1)
        live = norms > 0
        shared = spark.sparkContext.broadcast((ids[live], matrix[live] / norms[live, None]))

        def score(batches, shared=shared):
            ids, q = shared.value
            best: list[tuple[np.ndarray, np.ndarray]] = []
            for b in batches:
                kept = [(i, v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if v is not None and i is not None and len(v) == q.shape[1]]
                if not kept or not len(ids):
                    continue
                own = np.array([i for i, _ in kept], np.int64)
                x = np.array([v for _, v in kept], np.float64)
                n = np.linalg.norm(x, axis=1)
                own, x = own[n > 0], x[n > 0] / n[n > 0, None]
                for a in range(0, len(ids), BLOCK):
                    s = np.round(q[a : a + BLOCK] @ x.T, 9)
                    for i, row in enumerate(s, a):
                        order = np.lexsort((own, -row))[:k]
                        old = best[i] if i < len(best) else None
                        cand = (own[order], row[order]) if old is None else (np.concatenate([old[0], own[order]]), np.concatenate([old[1], row[order]]))
                        o = np.lexsort((cand[0], -cand[1]))[:k]
                        if old is None:
                            best.append((cand[0][o], cand[1][o]))
                        else:
                            best[i] = (cand[0][o], cand[1][o])
            if best:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, [len(x) for x, _ in best])), pa.array(np.concatenate([x for x, _ in best])), pa.array(np.concatenate([s for _, s in best]))], ["query_id", key, "score"]
                )

        got = over_batches(vectors.select(key, vector), score, f"query_id long, {key} long, score double")
        out = got if out is None else out.unionByName(got)
    return rank(out, key).filter(F.col("rank") <= k)


def sparse_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str) -> DataFrame:
    """query_id, key, score, rank by the dot product of queries(query_id, idx, weight) and vectors(key, idx, weight)."""
    q = queries.select("query_id", "idx", F.col("weight").alias("q"))
    scored = q.join(vectors, "idx").groupBy("query_id", key).agg(F.round(F.sum(F.col("q") * F.col("weight")), 9).alias("score"))
    return rank(scored, key).filter(F.col("rank") <= k)


def rank(scored: DataFrame, key: str) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))


def fuse(lists: Sequence[DataFrame], key: str, k: int, constant: int = RRF_K) -> DataFrame:
    """query_id, key, score, rank: reciprocal rank fusion of ranked lists."""
    parts = [x.select("query_id", key, (1.0 / (constant + F.col("rank"))).alias("s")) for x in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = both.groupBy("query_id", key).agg(F.round(F.sum("s"), 9).alias("score"))
    return rank(fused, key).filter(F.col("rank") <= k)


def overlap_score(query: Column, text: Column) -> Column:
    """Default reranker: share of the query's words that the text holds."""
    q = F.array_distinct(T.words(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.words(text))) / F.size(q)).otherwise(0.0)


def rerank(candidates: DataFrame, key: str, score: Column, top: int) -> DataFrame:
    """The top best candidates of each query by score, ties by their former rank."""
    best = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank", key)
    return candidates.withColumn("rerank_score", F.round(score, 9)).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top)


def require_rows(found: DataFrame, what: str) -> DataFrame:
    if found.isEmpty():
        raise EmptyCorpusError(f"nothing found for {what}")
    return found


def hit_rate(ranked: DataFrame, expected: DataFrame, cutoff: int = 10) -> DataFrame:
    """query_id, first_rank, hit: whether a clause whose number starts with an expected prefix ranks within the cutoff."""
    hits = ranked.join(expected, "query_id").filter(F.exists("expected_any", lambda p: F.startswith(F.col("clause_number"), p)))
    first = hits.groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return expected.select("query_id").join(first, "query_id", "left").select("query_id", "first_rank", F.coalesce(F.col("first_rank") <= cutoff, F.lit(False)).alias("hit"))


#: Prefixes of a text to embed, by side.
QUERY_PREFIX, DOCUMENT_PREFIX = "search_query: ", "search_document: "


def augmented(tokens: Column, hits: Column) -> Column:
    """Query tokens with the words of vocabulary hits and the digits of clause numbers among them, each once, sorted."""
    number = F.filter(hits, lambda h: h.rlike(r"^\d+\.\d+(\.\d+)*$"))
    phrase = F.filter(hits, lambda h: ~h.rlike(r"^\d+\.\d+(\.\d+)*$"))
    none = F.array().cast("array<string>")
    digits = F.flatten(F.transform(number, lambda h: F.split(h, r"\.")))
    words = F.filter(F.flatten(F.transform(phrase, lambda h: F.split(F.lower(h), r"\s+"))), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.concat(tokens, F.coalesce(digits, none), F.coalesce(words, none))))


def transform_queries(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """query_id, embed_text, hits, tokens of queries(query_id, query, language, norms, specific): vocabulary hits within the norms, modal terms, and tokens with all of them and the specific clauses."""
    from .corpus import scoped_hits

    found = scoped_hits(queries.select("query_id", "query", "norms"), "query_id", "query", vocabulary, "norms").groupBy("query_id").agg(F.collect_set("canonical").alias("found"))
    none = F.array().cast("array<string>")
    rows = queries.join(found, "query_id", "left").withColumn("hits", F.array_sort(F.array_distinct(F.concat(F.coalesce("found", none), T.modal_terms("query", "language")))))
    first = F.regexp_extract("query", T.CLAUSE, 0)
    return rows.select("query_id", F.concat(F.lit(QUERY_PREFIX), "query").alias("embed_text"), "hits", augmented(T.index_tokens("query", first), F.concat("hits", F.coalesce("specific", none))).alias("tokens"))


def hit_rates(hits: DataFrame, tiers: DataFrame) -> DataFrame:
    """tier, queries, hits, rate by tiers(query_id, tier), and over all."""
    rows = hits.join(tiers, "query_id").select(F.explode(F.array("tier", F.lit("all"))).alias("tier"), F.col("hit").cast("int").alias("hit"))
    return rows.groupBy("tier").agg(F.count("*").alias("queries"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 9).alias("rate"))


def merge_by_score(lists: Sequence[DataFrame], key: str, k: int) -> DataFrame:
    """query_id, key, score, rank: the best k of several collections by score, each key with its best one."""
    both = lists[0].select("query_id", key, "score")
    for x in lists[1:]:
        both = both.unionByName(x.select("query_id", key, "score"))
    return rank(both.groupBy("query_id", key).agg(F.max("score").alias("score")), key).filter(F.col("rank") <= k)
