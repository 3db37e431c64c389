"""Extension points for external models, with deterministic offline defaults."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items in a call, tries of a call, first and longest wait between tries in seconds, calls at once.
BATCH, TRIES, WAIT, LONGEST, PARALLEL = 50, 5, 0.5, 30.0, 10
WARN, CRITICAL = 0.10, 0.30


class PermanentError(RuntimeError):
    """A failure that another try can't mend."""


def permanent(e: Exception) -> bool:
    """Whether another try is useless: a client error other than too many requests."""
    status = getattr(e, "status", None) or getattr(getattr(e, "response", None), "status_code", None)
    return isinstance(e, PermanentError) or (isinstance(status, int) and 400 <= status < 500 and status != 429)


def retried(call: Callable, tries: int = TRIES, wait: float = WAIT) -> Callable:
    """call with growing, slightly random waits between its tries."""

    def run(x):
        for k in range(tries):
            try:
                return call(x)
            except Exception as e:
                if permanent(e) or k + 1 == tries:
                    raise
                time.sleep(min(wait * 2**k, LONGEST) * (1 + random.random() / 2))

    return run


def with_fallback(call: Callable, local: Callable, probe: str = "probe") -> Callable:
    """call where a probe of it succeeds, else the local model; found out once in each worker."""
    chosen: list[Callable] = []

    def run(texts):
        if not chosen:
            try:
                call([probe])
                chosen.append(call)
            except Exception:
                chosen.append(local)
        return chosen[0](texts)

    return run


def hashed_vector(text: str, size: int = 64) -> list[float]:
    """Default embedding: signed feature hashing of the words, of unit length."""
    v = np.zeros(size)
    for w in (text or "").lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % size] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embed(rows: DataFrame, text: str, fn: Callable[[Sequence[str]], Sequence[Sequence[float]]] | None = None, batch: int = BATCH, tries: int = TRIES, wait: float = WAIT, parallel: int = PARALLEL) -> DataFrame:
    """rows with embedding and error: fn(texts) in batches with backoff, some of them at once; a failing batch is tried item by item, and only failing items carry an error."""
    call = fn or (lambda texts: [hashed_vector(t) for t in texts])

    attempt = retried(lambda texts: [list(map(float, v)) for v in call(texts)], tries, wait)

    def one(part: list[str]) -> list[tuple]:
        try:
            return [(v, None) for v in attempt(part)]
        except Exception:
            out = []
            for t in part:
                try:
                    out.append((attempt([t])[0], None))
                except Exception as e:
                    out.append((None, str(e)[:200]))
            return out

    def run(frames):
        with ThreadPoolExecutor(parallel) as pool:
            for f in frames:
                texts = [t if t is not None else "" for t in f[text]]
                got = [x for part in pool.map(one, [texts[a : a + batch] for a in range(0, len(texts), batch)]) for x in part]
                yield f.assign(embedding=pd.Series([v for v, _ in got], index=f.index, dtype=object), error=pd.Series([e for _, e in got], index=f.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, embedding array<double>, error string")


def complete(rows: DataFrame, prompt: str, fn: Callable[[str], str], tries: int = 3, wait: float = WAIT) -> DataFrame:
    """rows with answer and error of a chat model on the prompt; a failing call leaves the answer null."""
    ask = retried(fn, tries, wait)

    def run(frames):
        for f in frames:
            answers, errors = [], []
            for p in f[prompt]:
                try:
                    answers.append(ask(p))
                    errors.append(None)
                except Exception as e:
                    answers.append(None)
                    errors.append(str(e)[:200])
            yield f.assign(answer=pd.Series(answers, index=f.index, dtype=object), error=pd.Series(errors, index=f.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, answer string, error string")


def check_failures(embedded: DataFrame, critical: float = CRITICAL) -> float:
    """Share of failed items; above critical nothing may be written."""
    rate = embedded.agg(F.avg(F.col("error").isNotNull().cast("int"))).first()[0] or 0.0
    if rate > critical:
        raise RuntimeError(f"{rate:.0%} of the embeddings failed")
    return rate


def failure_states(embedded: DataFrame, key: str, warn: float = WARN, critical: float = CRITICAL) -> DataFrame:
    """key, n, failed, rate, state of embedded(key, error): ok, warn above the first threshold, critical above the second."""
    rows = embedded.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    rate = F.col("failed") / F.col("n")
    return rows.withColumn("rate", F.round(rate, 9)).withColumn("state", F.when(rate > critical, "critical").when(rate > warn, "warn").otherwise("ok"))


def check_collection(existing: dict | None, model: str, sparse_dimension: int) -> dict:
    """The sidecar row of a vector collection; another model or dimension than the stored one is refused, a missing row is taken over."""
    want = {"model": model, "sparse_dimension": sparse_dimension}
    if existing and any(existing.get(k) != v for k, v in want.items()):
        raise RuntimeError(f"collection was built with {existing}, not {want}")
    return want
