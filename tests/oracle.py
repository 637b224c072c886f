"""Compare a registered query with its oracle SQL: names, row count, values regardless of order."""

from __future__ import annotations

import collections
import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return ("dec", format(value, "f"))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), collections.Counter(tuple(plain(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
         "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def compare(spark, con, name, run, sql, sf_dir) -> list[str]:
    """Differences as text, empty when the two sides agree."""
    df = run(spark, sf_dir)
    got_cols, got = bag(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cur.description}
    want_cols, want = bag([d[0] for d in cur.description], cur.fetchall())
    problems = []
    if got_cols != want_cols:
        return [f"{name}: columns {got_cols} != {want_cols}"]
    for column, kind in df.dtypes:
        if KINDS.get(kind, kind) != types[column]:
            problems.append(f"{name}: type of {column}: {kind} != {types[column]}")
    if sum(got.values()) != sum(want.values()):
        problems.append(f"{name}: rows {sum(got.values())} != {sum(want.values())}")
    only_got, only_want = list((got - want).items())[:3], list((want - got).items())[:3]
    if only_got or only_want:
        problems.append(f"{name} {got_cols}: only spark {only_got}; only sql {only_want}")
    if sum(got.values()) == 0:
        problems.append(f"{name}: empty result")
    return problems
