"""Cutting a series into blocks so that one long series still runs on many tasks.

A window over ``partitionBy(keys)`` puts a whole series into one task.  Here every
series is cut into blocks of ``rows`` grid slots and windows run per (keys, block):

* bounded frames read a *halo*: rows near a block edge are copied into the
  neighbouring block, and the copies are dropped afterwards (``spread`` / ``settle``);
* unbounded frames read a *carry*: one summary row per block, combined by a window
  over the summaries only (``carry_last``, ``running_totals``).

Both give exactly the rows the uncut window would give.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

POS = "_pos"
BLK = "_blk"


@dataclass(frozen=True)
class Series:
    """How a keyed series lies on its grid and how it is cut."""

    keys: tuple[str, ...] = ("zone",)
    ts: str = "ts"
    step: int = 900
    rows: int = 2880

    def position(self, ts: str | Column | None = None) -> Column:
        """Slot number of a time on this grid (slot 0 starts at the epoch)."""
        t = F.col(self.ts) if ts is None else (F.col(ts) if isinstance(ts, str) else ts)
        return F.floor(F.unix_seconds(t) / F.lit(self.step)).cast("long")

    def time_of(self, pos: Column) -> Column:
        return F.timestamp_seconds(pos * F.lit(self.step))

    @property
    def home(self) -> Column:
        """The block that owns a row."""
        return F.floor(F.col(POS) / F.lit(self.rows)).cast("long")

    @cached_property
    def over(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, BLK).orderBy(POS)

    @cached_property
    def upto(self) -> WindowSpec:
        return self.over.rowsBetween(Window.unboundedPreceding, 0)

    def frame(self, lo: int, hi: int = 0) -> WindowSpec:
        return self.over.rowsBetween(lo, hi)

    def cut(self, rows: int) -> "Series":
        return replace(self, rows=rows)


QUARTER = Series(step=900, rows=2880)
HOURLY = Series(step=3600, rows=2160)


def spread(df: DataFrame, s: Series, back: int = 0, ahead: int = 0) -> DataFrame:
    """Add slot and block, copying a row into each block whose halo it lies in.

    A block reads ``back`` slots before and ``ahead`` slots after its own rows.
    """
    df = df.withColumn(POS, s.position())
    if not back and not ahead:
        return df.withColumn(BLK, s.home)
    first = F.floor((F.col(POS) - F.lit(ahead)) / F.lit(s.rows)).cast("long")
    last = F.floor((F.col(POS) + F.lit(back)) / F.lit(s.rows)).cast("long")
    return df.withColumn(BLK, F.explode(F.sequence(first, last)))


def settle(df: DataFrame, s: Series) -> DataFrame:
    """Keep each row once, in the block that owns it."""
    return df.where(F.col(BLK) == s.home).drop(POS, BLK)


def attach(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-key values to a frame; without keys ``other`` is one row, which is read
    as a scalar subquery instead of joined."""
    if keys:
        return df.join(other, list(keys), how)
    row = other.select(F.struct(*other.columns).alias("_row")).scalar()
    return df.withColumn("_one", row).select("*", "_one.*").drop("_one")


Stage = Callable[[Series], Mapping[str, Column]]


def windowed(
    df: DataFrame,
    s: Series,
    stages: Sequence[Stage],
    back: int = 0,
    ahead: int = 0,
) -> DataFrame:
    """Run stages of window columns with bounded frames over one exchange.

    Each stage may read the columns of the stages before it; ``back`` and
    ``ahead`` are the summed reach of all stages in rows.
    """
    out = spread(df, s, back, ahead)
    for stage in stages:
        out = out.withColumns(dict(stage(s)))
    return settle(out, s)


def carry_last(
    df: DataFrame, s: Series, marks: Mapping[str, Column], more: Mapping[str, Column] | None = None
) -> DataFrame:
    """Per (keys, block): the last non-null value of each mark in earlier blocks,
    and ``_origin``, the first slot of the series.  ``df`` carries POS and BLK.
    ``more``: further aggregates of the block's own rows."""
    more = more or {}
    tails = (
        df.where(F.col(BLK) == s.home)
        .groupBy(*s.keys, BLK)
        .agg(
            F.min(POS).alias("_origin"),
            *[F.max_by(m, F.when(m.isNotNull(), F.col(POS))).alias(n) for n, m in marks.items()],
            *[x.alias(n) for n, x in more.items()],
        )
    )
    before = Window.partitionBy(*s.keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*s.keys)
    return tails.select(
        *s.keys,
        BLK,
        F.min("_origin").over(whole).alias("_origin"),
        *[F.last(n, ignorenulls=True).over(before).alias(n) for n in marks],
        *more,
    )


def last_known(df: DataFrame, s: Series, marks: Mapping[str, Column]) -> DataFrame:
    """Add for each mark its last non-null value at or before the row (no limit).

    ``df`` carries POS and BLK without halo rows, or with a halo and marks that
    are right wherever they are not null.
    """
    names = {n: f"_in_{n}" for n in marks}
    carry = carry_last(df, s, {names[n]: m for n, m in marks.items()})
    local = df.withColumns({n: F.last(m, ignorenulls=True).over(s.upto) for n, m in marks.items()})
    joined = local.join(carry, [*s.keys, BLK])
    return joined.withColumns(
        {n: F.coalesce(F.col(n), F.col(names[n])) for n in marks}
    ).drop(*names.values())


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[Column],
    sums: Mapping[str, Column],
) -> DataFrame:
    """Cumulative sums in ``order``, computed per (keys, block) plus the totals of
    earlier blocks.  ``block`` must grow with ``order``."""
    w = Window.partitionBy(*keys, block).orderBy(*order)
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, block).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    carry = totals.select(
        *keys, block, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    local = df.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    out = local.join(carry, [*keys, block])
    return out.withColumns(
        {n: F.coalesce(F.col(n), F.lit(0)) + F.col(f"_c_{n}") for n in sums}
    ).drop(*[f"_c_{n}" for n in sums])
