"""Runs a registered query and its SQL side by side and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

DATA = os.environ.get("TEST_DATA", "/root/testdata")


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    result = con.sql(sql)
    names = list(result.columns)
    theirs = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)} rows"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if different:
        return f"{len(different)} of {len(ours)} rows differ, first {different[0]}"
    if not ours:
        return "no rows on either side"
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    kinds = dict(zip(names, (str(t) for t in result.types)))
    same = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    wrong = {n: (t, kinds[n]) for n, t in types.items() if same.get(t) != kinds[n]}
    return f"types differ: {wrong}" if wrong else None
