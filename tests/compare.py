"""Run a registered query and its check SQL side by side."""

from __future__ import annotations

import glob
import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool, int)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "array<int>": "INTEGER[]", "array<bigint>": "BIGINT[]", "array<double>": "DOUBLE[]",
}


def differences(spark_df, con, sql, limit: int = 5) -> list:
    got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    out = []
    if sorted(names) != sorted(spark_df.columns):
        out.append(("columns", sorted(spark_df.columns), sorted(names)))
    want_types = {d[0]: str(d[1]) for d in cur.description}
    got_types = {f.name: SQL_TYPES.get(f.dataType.simpleString(), "?") for f in spark_df.schema}
    out += [("type", c, t, want_types.get(c)) for c, t in got_types.items() if t != want_types.get(c)]
    if len(got) != len(want):
        out.append(("rows", len(got), len(want)))
    out += [(a, b) for a, b in zip(got, want) if a != b][:limit]
    return out
