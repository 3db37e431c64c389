"""Token counts by a public tokenizer whose vocabulary file is named by path, never trained or copied."""

from __future__ import annotations

import base64
import functools
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import over_batches, settle, widen

#: A file of token ranks as described in /opt/tokenizers/README.md.
VOCABULARY = os.environ.get("CLAUSEWORKS_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoding(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(batches, vocabulary: str):
    encode = encoding(vocabulary).encode_ordinary
    for b in batches:
        n = [len(encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*b.schema.names[:-1], "tokens"])


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source (lower case, one spelling), tokens of documents(doc_id, source, text); each doc_id once, null and blank texts 0."""
    rows = documents.filter("doc_id is not null").select("doc_id", F.lower(F.regexp_replace(F.trim("source"), "[- ]", "_")).alias("source"), "text")
    counted = over_batches(widen(rows), lambda batches: _count(batches, vocabulary), "doc_id long, source string, tokens long")
    return settle(counted.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens")), "token_counts")
