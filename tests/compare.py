"""A query's rows against its SQL in DuckDB over the same files."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


def _kind(t: str) -> str:
    t = t.upper()
    if t in ("LONG", "BIGINT", "INT", "INTEGER", "SHORT", "BYTE", "HUGEINT", "TINYINT", "SMALLINT"):
        return "int" if t != "HUGEINT" else "hugeint"
    return {"STRING": "VARCHAR", "TIMESTAMP_NTZ": "TIMESTAMP"}.get(t, t)


def differences(spark, con, name: str, query, sql: str, sf_dir: str) -> list[str]:
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != columns:
        return [f"columns {columns} and {sorted(rel.columns)}"]
    theirs = dict(zip(rel.columns, map(str, rel.types), strict=True))
    found = [f"{c}: {t} and {theirs[c]}" for c, t in df.dtypes if _kind(t) != _kind(theirs[c])]
    at = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    if got != want:
        found.append(f"{len(got)} and {len(want)} rows, e.g. {[r for r in got if r not in set(want)][:2]} and {[r for r in want if r not in set(got)][:2]}")
    return found
