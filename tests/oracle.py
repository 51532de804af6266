"""Compares queries with their SQL on DuckDB."""

import math
from pathlib import Path

import duckdb


def connect(d):
    c = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def norm(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        v = float(v)
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    return str(v)


def difference(df, con, sql):
    """None, or what differs."""
    rel = con.sql(sql)
    cols = sorted(df.columns)
    if cols != sorted(rel.columns):
        return f"columns {cols} {sorted(rel.columns)}"
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    want = sorted(tuple(norm(v) for v in r) for r in rel.select(*(duckdb.ColumnExpression(x) for x in cols)).fetchall())
    if got == want:
        return None
    only = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
    return f"{len(got)} rows, {len(want)} wanted; only here {only[0]}; only there {only[1]}"
