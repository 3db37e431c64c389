"""Whole pipelines composed of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, hooks, ingest, retrieval, segment
from ..runtime import settle


def index_clauses(clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with content type, references and tokens, and their sparse vectors."""
    parts = segment.chunks(clauses.select("clause_uid", "text")).join(clauses.select("clause_uid", "norm_id", "language", "top_level_family", "clause_number"), "clause_uid")
    chunks = parts.select(
        T.chunk_id("norm_id", "clause_number", F.col("part"), F.lit(1)).alias("chunk_id"), "clause_uid", "norm_id", "language", "top_level_family", "clause_number", "part", "text", "words", "content_type",
        T.cross_references("text").alias("references"), T.index_tokens("text", "clause_number").alias("tokens"),
    )
    return chunks, corpus.bm25_vectors(chunks, "chunk_id")


def retrieve(chunks: DataFrame, sparse: DataFrame, queries: DataFrame, norms: Sequence[str], language: str | None = None, top: int = 15, keep: int = 5, embedder=None) -> DataFrame:
    """Filtered hybrid retrieval of queries(query_id, query): dense and sparse lists, rank fusion, rerank, best keep."""
    allowed = retrieval.require_rows(chunks.filter(retrieval.norm_filter(norms, language)), f"norms {list(norms)}")
    allowed = settle(allowed.withColumn("vec_id", F.monotonically_increasing_id()), "allowed")  # numbers of this table, so no two chunks share one
    dense = hooks.embed(allowed.select("vec_id", "text"), "text", embedder).select("vec_id", "embedding")
    asked = hooks.embed(queries, "query", embedder).select("query_id", "embedding")
    first = max(20, 2 * top)
    lists = [retrieval.dense_top_k(dense, asked, first)]
    tokens = queries.select("query_id", T.index_tokens("query").alias("tokens"))
    numbered = sparse.join(allowed.select("chunk_id", "vec_id"), "chunk_id").drop("chunk_id")
    lists.append(retrieval.sparse_top_k(numbered, corpus.query_vectors(tokens, "query_id"), first, "vec_id"))
    fused = retrieval.fuse(lists, "vec_id", top).join(allowed, "vec_id").join(queries, "query_id")
    return retrieval.rerank(fused, "chunk_id", retrieval.overlap_score(F.col("query"), F.col("text")), keep).select("query_id", "chunk_id", "clause_number", "score", "rerank_score", "place")


AUDIT = "Say of each section whether it is real content, and which clause family (4 to 10) it serves, as a JSON array of objects with id, valid and clause_family:\n"


def audit(sections: DataFrame, key: str, ask, longest: int = ingest.PREVIEW) -> DataFrame:
    """sections(key, section_id, section_type, title, raw_text) with llm_valid, predicted_clause_family and kept, by one call of ask(prompt) a document; a failing or unusable answer keeps everything."""
    item = F.struct(F.col("section_id").alias("id"), "section_type", "title", "preview")
    prompts = ingest.previews(sections, longest).groupBy(key).agg(F.concat(F.lit(AUDIT), F.to_json(F.array_sort(F.collect_list(item)))).alias("prompt"))
    judged = settle(ingest.verdicts(hooks.complete(prompts, "prompt", ask).select(key, F.col("answer").alias("raw")), key), "verdicts")
    return ingest.audited(sections, judged, key)
