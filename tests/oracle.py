"""Runs a registered query and its DuckDB SQL on one folder, and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, bool):
        return x
    if isinstance(x, int):
        return float(x) if abs(x) < 2**53 else x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    return x


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Why the two differ, or an empty string."""
    df = query(spark, sf_dir)
    got_names = sorted(df.columns)
    got = [tuple(plain(r[c].asDict() if hasattr(r[c], "asDict") else r[c]) for c in got_names) for r in df.collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(plain(r[i]) for i in order) for r in rel.fetchall()]
    if sorted(names) != got_names:
        return f"columns {got_names} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    a, b = sorted(got, key=repr), sorted(want, key=repr)
    for x, y in zip(a, b):
        if x != y:
            return f"{x} and {y}"
    return ""
