"""Compare a query with its SQL twin the way a reader would: same columns, same rows, any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "asDict"):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in records), key=repr)


def compare(df, con, sql) -> str | None:
    """None when equal, else a short account of the difference."""
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    want = rows_of(names, answer.fetchall())
    got = rows_of(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; ours {got[:2]} theirs {want[:2]}"
    kinds = {type(v) for row in want for v in row}
    if "Decimal" in {k.__name__ for k in kinds}:
        return "oracle returns decimals"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            cut = [(a, b) for a, b in zip(g, w) if a != b or type(a) is not type(b)]
            for a, b in cut:
                if isinstance(a, str) and isinstance(b, str):
                    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                    return f"row {str(g)[:60]} at {at}: ours ...{a[max(0, at - 80) : at + 80]!r} theirs ...{b[max(0, at - 80) : at + 80]!r}"
            return f"ours {g} theirs {w}"
    return None if want else "no rows"
