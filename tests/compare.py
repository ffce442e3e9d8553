"""Compare a Spark result with its SQL twin: schema, row count and values, order aside."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_SAME = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "array<int>": "INTEGER[]",
    "array<string>": "VARCHAR[]",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def differences(df, con, sql: str) -> list[str]:
    found = []
    rel = con.sql(sql)
    left = {n: _SAME.get(t, t) for n, t in df.dtypes}
    right = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    if left != right:
        found.append(f"schema: {left} != {right}")
        if set(left) != set(right):
            return found
    names = sorted(left)
    a = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    order = [rel.columns.index(n) for n in names]
    b = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
    if len(a) != len(b):
        found.append(f"rows: {len(a)} != {len(b)}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        found.append(f"values: {len(bad)} differ, first {str(bad[0])[:600]}")
    if not a:
        found.append("empty result")
    return found
