"""Run a query and its SQL twin and compare rows, names and values."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    rel = con.execute(sql)
    want_names = [d[0] for d in rel.description]
    want = table(want_names, rel.fetchall())
    got = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    problems = []
    if got[0] != want[0]:
        problems.append(f"columns {got[0]} != {want[0]}")
    if len(got[1]) != len(want[1]):
        problems.append(f"rows {len(got[1])} != {len(want[1])}")
    bad = [(g, w) for g, w in zip(got[1], want[1]) if repr(g) != repr(w)]
    if bad and not problems:
        problems.append(f"{len(bad)} rows differ, first: {bad[0][0]} != {bad[0][1]}")
    elif problems and got[0] == want[0]:
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        problems.append(f"only spark {sorted(a - b)[:2]} only sql {sorted(b - a)[:2]}")
    return problems
