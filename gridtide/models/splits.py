"""Chronological splits and training-set shaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.functions.scalars import finite_or_zero
from gridtide.operators.aggregates import dense_positions
from gridtide.operators.blocks import Series, attach
from gridtide.operators.windows import near

CORE_LAGS = ("imbl_lag_1", "imbl_lag_2", "imbl_roll_1h_mean")


def time_split(df: DataFrame, days: int, keys: Sequence[str] = ("zone",), ts: str = "ts") -> DataFrame:
    """Mark each row "train" up to the last time minus ``days``, "test" after it."""
    cut = df.groupBy(*keys).agg((F.max(ts) - F.make_dt_interval(days=F.lit(days))).alias("_cut"))
    out = attach(df, cut, keys)
    part = F.when(F.col(ts) <= F.col("_cut"), "train").otherwise("test")
    return out.withColumn("part", part).drop("_cut")


def tail_fraction(df: DataFrame, s: Series, fraction: float, least: int = 0) -> DataFrame:
    """Flag the last rows of each series (a share, at least so many) as ``valid``."""
    ranked = dense_positions(df, s)
    size = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_size"))
    held = F.greatest(F.floor(F.col("_size") * fraction), F.lit(least))
    out = ranked.join(size, list(s.keys))
    return out.withColumn("valid", F.col("_seq") >= F.col("_size") - held).drop("_seq", "_size")


def augment(df: DataFrame, s: Series, spike: Column, k: int = 2) -> DataFrame:
    """All rows plus a second copy of those within k rows of a spike."""
    tagged = near(df, s, spike, k, "_near")
    copies = F.sequence(F.lit(1), F.col("_near") + 1)
    return tagged.withColumn("_copy", F.explode(copies)).drop("_near", "_copy")


def augmented_weight(df: DataFrame, s: Series, spike: Column, k: int = 2) -> DataFrame:
    """The same effect as ``augment`` without copying rows: weight 2 near a spike."""
    return near(df, s, spike, k, "_near").withColumn("weight", 1.0 + F.col("_near")).drop("_near")


def clean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite_or_zero(c) for c in cols})
