"""Small literal frames and comparisons."""

from __future__ import annotations

import math
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import functions as F

T0 = datetime(2025, 1, 1)


def at(k: int, minutes: int = 15, start: datetime = T0) -> datetime:
    return (start + timedelta(minutes=minutes * k)).replace(tzinfo=timezone.utc)


def series(spark, columns: dict[str, list], minutes: int = 15, zone: str = "A", start: datetime = T0):
    """One dense series from value lists, NULL for None."""
    names = list(columns)
    n = len(columns[names[0]])
    rows = [(zone, at(k, minutes, start), *[columns[c][k] for c in names]) for k in range(n)]
    kinds = {
        c: "int" if all(isinstance(v, (int, type(None))) for v in columns[c]) else "double" for c in names
    }
    schema = "zone string, ts timestamp, " + ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return spark.createDataFrame(rows, schema)


def values(df, *cols: str) -> list:
    """Column values in time order (a list of tuples for several columns)."""
    rows = df.orderBy("zone", "ts").collect()
    return [r[cols[0]] for r in rows] if len(cols) == 1 else [tuple(r[c] for c in cols) for r in rows]


def close(a, b, tol: float = 1e-9) -> bool:
    if len(a) != len(b):
        return False
    for x, y in zip(a, b):
        if x is None or y is None:
            if x is not y:
                return False
        elif isinstance(x, tuple):
            if not close(list(x), list(y), tol):
                return False
        elif not (x == y if isinstance(x, (str, datetime)) else math.isclose(x, y, rel_tol=tol, abs_tol=tol)):
            return False
    return True


def wave_frame(spark, n: int, zones=("A", "B"), seed: int = 3, holes: float = 0.15):
    """Two seeded random series with holes, prices crossing the stress limits."""
    rng = np.random.default_rng(seed)
    out = None
    for z in zones:
        walk = 60 * np.sin(np.arange(n) / 17) + rng.normal(0, 120, n).cumsum() * 0.2 + rng.normal(0, 80, n)
        gone = rng.random(n) < holes
        cols = {
            "imbl_price": [None if g else float(v) for v, g in zip(walk, gone)],
            "direction": [None if g else int(np.sign(v)) for v, g in zip(rng.normal(0, 1, n), gone)],
            "windspeed_100m": [float(v) for v in rng.gamma(2, 3, n)],
            "temperature": [float(v) for v in rng.normal(4, 8, n)],
            "cloudcover": [float(v) for v in rng.uniform(0, 100, n)],
            "up_reg_price": [float(v) for v in rng.normal(50, 9, n)],
            "down_reg_price": [float(v) for v in rng.normal(40, 9, n)],
            "net_position_mw": [float(v) for v in rng.normal(0, 300, n)],
        }
        df = series(spark, cols, zone=z)
        out = df if out is None else out.unionByName(df)
    return out


def same_rows(a, b, digits: int = 7) -> bool:
    """Equality of two frames as sets of rows, doubles rounded."""
    def norm(df):
        cols = sorted(df.columns)
        sel = [
            (F.round(c, digits) + 0.0).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in cols
        ]
        return df.select(*sel)

    x, y = norm(a), norm(b)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
