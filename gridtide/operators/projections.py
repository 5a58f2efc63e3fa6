"""Column selection, filters, limits and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.functions.calendar import LOCAL_ZONE
from gridtide.functions.scalars import to_number
from gridtide.operators.blocks import attach


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order; missing ones are NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_number(c) for c in cols})


def known_columns(df: DataFrame, cols: Sequence[str] | None = None) -> set[str]:
    """Columns holding at least one value: one aggregate over all of them."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    return {c for c in cols if row[c]}


def drop_all_null(df: DataFrame) -> DataFrame:
    have = known_columns(df)
    return df.select(*[c for c in df.columns if c in have])


def prefer(df: DataFrame, a: str, b: str) -> str:
    """The first of two columns that exists."""
    return a if a in df.columns else b


def between(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    lit = lambda x: F.lit(x).cast("timestamp")
    return df.where(F.col(ts).between(lit(start), lit(end)))


def complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=[c for c in cols if c in df.columns])


def lookback(df: DataFrame, seconds: int, now: Column, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts) >= now - F.make_dt_interval(secs=F.lit(seconds)))


def local_days(
    df: DataFrame, first: str, last: str, ts: str = "ts", tz: str = LOCAL_ZONE
) -> DataFrame:
    """Rows of the local days first..last.  The day bounds are turned into instants,
    so the filter is on the raw time column and reaches the scan."""
    a = F.to_utc_timestamp(F.lit(first).cast("timestamp"), tz)
    b = F.to_utc_timestamp(F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"), tz)
    return df.where((F.col(ts) >= a) & (F.col(ts) < b))


def min_rows(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Rows of the groups that hold at least n rows."""
    big = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    return df.join(big.select(*by), list(by), "left_semi")


def still_valid(fc: DataFrame, now: Column, ts: str = "ts") -> DataFrame:
    return fc.where(F.col(ts) >= F.date_trunc("hour", now))


def latest(df: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    """The newest n rows of the whole table, oldest first."""
    return df.orderBy(F.col(ts).desc()).limit(n).orderBy(ts)


def latest_per(df: DataFrame, n: int, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """The newest n rows of each key (a ranked window, which Spark limits per task
    before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def last_row(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """The newest row of each key, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != ts]
    top = df.groupBy(*keys).agg(F.max(F.struct(ts, *rest)).alias("_r"))
    return top.select(*keys, "_r.*").select(*df.columns)


def upcoming(runs: DataFrame, now: Column, n: int, keys: Sequence[str] = ("zone",),
             ts: str = "ts", run: str = "generated_at") -> DataFrame:
    """The next n rows of each key's newest run, from ``now`` on."""
    from gridtide.operators.joins import latest_run

    rows = latest_run(runs, keys, run).where(F.col(ts) >= now)
    w = Window.partitionBy(*keys).orderBy(ts)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def tail_days(df: DataFrame, days: int, keys: Sequence[str] = ("zone",), ts: str = "ts") -> DataFrame:
    """Rows within the last days of each series."""
    top = df.groupBy(*keys).agg(F.max(ts).alias("_hi"))
    out = attach(df, top, keys)
    return out.where(F.col(ts) > F.col("_hi") - F.make_dt_interval(days=F.lit(days))).drop("_hi")


def sort_time(df: DataFrame, ts: str = "ts", *more: str) -> DataFrame:
    return df.orderBy(ts, *more)


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """A fixed random sample: the n rows with the smallest digest of seed and key, one that
    any engine can repeat."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in key]))
    return df.orderBy(digest, *key).limit(n)


def union_dedup(frames: Sequence[DataFrame], key: Sequence[str], keep: str = "first") -> DataFrame:
    """Chunks in order, one row per key from the first (or last) chunk that has it."""
    from gridtide.operators.grid import dedup

    tagged = [f.withColumn("_chunk", F.lit(i)) for i, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return dedup(both, key, ["_chunk"], keep).drop("_chunk")


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)
