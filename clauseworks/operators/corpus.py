"""Corpus statistics: TF-IDF keywords, BM25 sparse vectors, vocabulary scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..runtime import settle

K1, B = 1.2, 0.75
#: Vocabulary forms that may be broadcast; beyond it they meet the texts by a shuffled join.
BROADCAST_FORMS = 300_000


def term_counts(chunks: DataFrame, key: str, column: str = "text") -> DataFrame:
    """key, term, tf: map-side combined counts of words and word pairs."""
    words = chunks.select(key, T.words(F.coalesce(column, F.lit(""))).alias("w"))
    return words.select(key, F.explode(T.with_pairs(F.col("w"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def inverse_document_frequency(counts: DataFrame, n: int) -> DataFrame:
    """term, df, idf = ln((n + 1) / (df + 1)) + 1."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1)


def tfidf_keywords(chunks: DataFrame, key: str, column: str = "text", top: int = 5) -> DataFrame:
    """key, rank, term, score: best terms of each chunk, phrases before words, then by name."""
    counts = term_counts(chunks, key, column)  # both uses share one exchange
    scored = counts.join(inverse_document_frequency(counts, chunks.count()), "term").withColumn("score", F.round(F.col("tf") * F.col("idf"), 9))
    best = Window.partitionBy(key).orderBy(F.desc("score"), F.desc(F.size(F.split("term", " "))), "term")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select(key, "rank", "term", "score")


def bm25_vectors(chunks: DataFrame, key: str, tokens: str = "tokens", k1: float = K1, b: float = B) -> DataFrame:
    """key, idx, weight: BM25 weights by hashed token, summed where tokens collide; non-positive weights dropped."""
    chunks = settle(chunks.select(key, tokens), "tokens")  # read for the mean, the frequencies and the weights
    long = chunks.select(key, F.size(tokens).alias("len"), F.explode(tokens).alias("token")).groupBy(key, "len", "token").agg(F.count("*").alias("tf"))
    n, mean = chunks.agg(F.count("*"), F.avg(F.size(tokens))).first()
    df = long.groupBy("token").agg(F.count("*").alias("df"))
    w = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / (mean or 1.0)))
    weighted = long.join(df, "token").withColumn("weight", w).filter("weight > 0")
    return weighted.groupBy(key, T.token_index("token").alias("idx")).agg(F.sum("weight").alias("weight"))


def query_vectors(queries: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """key, idx, weight: one for each token, summed on collision."""
    return queries.select(key, F.explode(tokens).alias("token")).groupBy(key, T.token_index("token").alias("idx")).agg(F.count("*").cast("double").alias("weight"))


def _sequences(words: str, n: int):
    return F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))


def vocabulary_hits(texts: DataFrame, key: str, column: str, forms: DataFrame) -> DataFrame:
    """key, canonical: vocabulary entries of which some form(canonical, form) stands as whole words in the text.

    Forms are cut into words as the texts are, and meet them by an equi-join on word sequences of every length that a form has, not
    by testing every form on every text.
    """
    cut = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    known = forms.select("canonical", cut("form").alias("f")).filter(F.size("f") > 0)
    known = known.select("canonical", F.array_join("f", " ").alias("form"), F.size("f").alias("n")).distinct()
    counts = dict(map(tuple, known.groupBy("n").count().collect()))
    lengths, known = sorted(counts), known.drop("n")
    if sum(counts.values()) <= BROADCAST_FORMS:
        known = F.broadcast(known)
    words = texts.select(key, cut(column).alias("w"))
    none = F.array().cast("array<string>")
    runs = F.concat(none, *[F.when(F.size("w") >= n, _sequences("w", n)).otherwise(none) for n in lengths])
    grams = words.select(key, F.explode(F.array_distinct(runs)).alias("form"))
    return grams.join(known, "form").select(key, "canonical").distinct()


def scoped_hits(texts: DataFrame, key: str, column: str, vocabulary: DataFrame, scope: str) -> DataFrame:
    """key, canonical: the entries of vocabulary(canonical, standards, form) that stand in the text and hold for one of the standards in its scope (all where it is empty)."""
    hits = vocabulary_hits(texts, key, column, vocabulary.select("canonical", "form"))
    standards = vocabulary.select("canonical", F.explode("standards").alias("standard")).distinct()
    wide = texts.filter(F.size(F.coalesce(scope, F.array().cast("array<string>"))) == 0).select(key)
    narrow = hits.join(texts.select(key, F.explode(scope).alias("standard")).distinct(), key).join(standards, ["canonical", "standard"], "left_semi").select(key, "canonical")
    return narrow.unionByName(hits.join(wide, key, "left_semi").select(key, "canonical")).distinct()


def sorted_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """key, indices, values: each sparse vector as two arrays in the order of the indices."""
    pairs = vectors.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("v"))
    return pairs.select(key, F.transform("v", lambda x: x["idx"]).alias("indices"), F.transform("v", lambda x: x["weight"]).alias("values"))
