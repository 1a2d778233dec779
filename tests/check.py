"""Side-by-side comparison of a registered query and its SQL on DuckDB."""

from __future__ import annotations

import math
import os
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, name, fn, sql, sf_dir, con=None):
    """Return (ok, message)."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return len(got) > 0, f"rows only: {len(got)} rows, spark {t1 - t0:.1f}s"
    rel = (con or duck(sf_dir)).execute(sql)
    want_names, want = _rows([d[0] for d in rel.description], rel.fetchall())
    t2 = time.time()
    times = f"{len(got)} rows, spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s"
    if got_names != want_names:
        return False, f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return False, f"row counts {len(got)} != {len(want)} ({times})"
    bad = [(a, b) for a, b in zip(got, want) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. {str(bad[0][0])[:400]} != {str(bad[0][1])[:400]} ({times})"
    return True, times
