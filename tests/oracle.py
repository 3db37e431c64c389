"""Runs a query and its SQL side by side and compares the rows."""

import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings iso_norms iso_clauses keyword_registry term_probes company ini_types internaldocs parsed_sections parsed_documents source_targets container_specs".split()


def connect(folder):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return (int(x) if x == int(x) else round(x, 9)) if math.isfinite(x) else None
    if isinstance(x, bool):
        return x
    return str(x) if hasattr(x, "isoformat") else x


def rows_of(frame):
    cols = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False, name=None)), key=repr)


def difference(spark, folder, run, sql):
    """None when equal, else what differs."""
    got, want = run(spark, folder).toPandas(), connect(folder).sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; only one has {sorted(set(a) ^ set(b), key=repr)[:4]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ: {bad[:3]}" if bad else None
