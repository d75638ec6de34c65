"""Runs a query and its DuckDB SQL over the same tables and compares rows without regard to order: floats by a tolerance, all else exactly."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

DATA = "/root/testdata"


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() else round(float(v), 5)
    return round(v, 5) if isinstance(v, float) else v if isinstance(v, int) else str(v)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=lambda r: [(v is None, type(v) is str, float(v) if isinstance(v, (int, float)) else str(v)) for v in r])


def differences(spark, con, name: str, query, sql: str, folder: str) -> str:
    """Empty if both agree."""
    df = query(spark, folder)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} against {sorted(names)}"
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, cur.fetchall())
    if len(got) != len(want):
        return f"{name}: {len(got)} rows against {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)) for x, y in zip(a, b, strict=True))]
    return f"{name}: {len(bad)} rows differ, first {bad[0]}" if bad else ""
