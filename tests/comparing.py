"""Rows of two engines, made comparable."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return bytes(v) if isinstance(v, bytearray) else v


def rows_of(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(v) for v in r) for r in df.select(*names).collect())


def duck_rows(con, sql: str) -> tuple[list[str], Counter]:
    got = con.execute(sql)
    cols = [d[0] for d in got.description]
    names = sorted(cols)
    at = [cols.index(n) for n in names]
    return names, Counter(tuple(_plain(r[i]) for i in at) for r in got.fetchall())


def differences(ours, theirs, n: int = 3) -> str:
    (a, x), (b, y) = ours, theirs
    if a != b:
        return f"columns {a} and {b}"
    return "" if x == y else f"{sum(x.values())} and {sum(y.values())} rows; only ours: {list((x - y).items())[:n]}; only theirs: {list((y - x).items())[:n]}"
