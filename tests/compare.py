"""Run a registered query and its SQL over the same tables and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else (int(x) if x == int(x) and abs(x) < 2**53 else x) if math.isfinite(x) else x
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    if hasattr(x, "asDict"):
        return tuple(_plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(_plain(y) for y in x.values())
    if type(x).__name__ == "Decimal":
        return int(x) if x == int(x) else float(x)
    return x


def compare(spark_df, con, sql: str) -> list[str]:
    """Problems found; empty when rows, column names and values agree."""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = {d[0]: str(d[1]) for d in res.description}
    want = res.fetchall()
    problems = []
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    order = sorted(names)
    spark_kinds = dict(spark_df.dtypes)
    got = spark_df.select(order).collect()
    pos = [names.index(c) for c in order]
    a = sorted((tuple(_plain(x) for x in r) for r in got), key=repr)
    b = sorted((tuple(_plain(r[p]) for p in pos) for r in want), key=repr)
    alias = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for c in order:
        if alias.get(spark_kinds[c], kinds[c]) != kinds[c]:
            problems.append(f"type {c}: {spark_kinds[c]} / {kinds[c]}")
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    elif a != b:
        bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        problems.append(f"{len(bad)} of {len(a)} rows differ ({order}); first {str(bad[0])[:700]}")
    return problems
