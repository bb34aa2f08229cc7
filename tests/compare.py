"""Runs registered queries beside their DuckDB texts."""

from __future__ import annotations

import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(frame):
    frame = frame[sorted(frame.columns)]
    whole = [c for c in frame if frame[c].dtype.kind == "f" and frame[c].isna().any() and (frame[c].dropna() % 1 == 0).all()]
    frame = frame.astype(dict.fromkeys(whole, "Int64"))  # integers with nulls among them
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


def mismatch(spark, name: str, sf_dir: str) -> str:
    """Empty if the query and its SQL text agree."""
    import __spark_entry__ as e

    got = e.queries()[name](spark, sf_dir).toPandas()
    want = duck(sf_dir).execute(e.oracle_sql()[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    want = want.astype({c: got[c].dtype for c in got.columns if got[c].dtype.kind in "if" and want[c].notna().all()})
    a, b = normal(got), normal(want)
    if a != b:
        odd = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"{len(a)} rows, {len(b)} expected: {odd}"
    return ""
