"""Time alignment: buckets, resampling, dense grids, fills, intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions.calendar import LOCAL_ZONE, local
from gridtide.operators.blocks import BLK, POS, Series, attach, last_known, spread
from gridtide.operators.quantiles import exact_percentiles, stacked_percentiles


def bucket(ts: str | Column, step: int, mode: str = "floor") -> Column:
    """Floor, ceil or round (midpoints up) a time to a step in seconds."""
    t = F.col(ts) if isinstance(ts, str) else ts
    x = F.unix_micros(t) / F.lit(step * 1_000_000)
    n = {"floor": F.floor(x), "ceil": F.ceil(x), "round": F.floor(x + 0.5)}[mode]
    return F.timestamp_seconds(n * F.lit(step))


def local_bucket(ts: str | Column, unit: str, tz: str = LOCAL_ZONE) -> Column:
    """Local hour, day, or month-end label of an instant, as a local time."""
    t = local(ts, tz)
    if unit == "month_end":
        return F.last_day(t).cast("timestamp")
    return F.date_trunc(unit, t)


def resample(
    df: DataFrame,
    s: Series,
    aggs: Mapping[str, Column],
    dense: bool = False,
) -> DataFrame:
    """Aggregate rows to the grid of ``s``; ``dense`` adds the empty slots as NULLs."""
    at = s.time_of(s.position())
    cols = [c.alias(n) for n, c in aggs.items()]
    out = df.groupBy(*s.keys, at.alias(s.ts)).agg(*cols)
    return densify(out, s) if dense else out


def resample_median(df: DataFrame, s: Series, value: str, name: str) -> DataFrame:
    """Exact median per grid slot, without gathering a slot in one task."""
    at = df.withColumn(s.ts, s.time_of(s.position()))
    return exact_percentiles(at, [*s.keys, s.ts], value, {name: 0.5})


def grid_slots(spans: DataFrame, s: Series, lo: str, hi: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keys, ts) for every slot number in [lo, hi] of each row of ``spans``, with the
    columns ``keep`` of that row.

    Expanded block by block, so no array is longer than one block.
    """
    rows = F.lit(s.rows)
    blocks = spans.withColumn(
        BLK, F.explode(F.sequence(F.floor(F.col(lo) / rows), F.floor(F.col(hi) / rows)))
    )
    first = F.greatest(F.col(lo), F.col(BLK) * rows)
    last = F.least(F.col(hi), (F.col(BLK) + 1) * rows - 1)
    return blocks.withColumn(POS, F.explode(F.sequence(first, last))).select(
        *s.keys, s.time_of(F.col(POS)).alias(s.ts), *keep
    )


def densify(
    df: DataFrame,
    s: Series,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Every slot of each series between its own first and last row, or between
    two given times; rows off the grid are dropped, empty slots hold NULLs."""
    pos = s.position()
    spans = df.groupBy(*s.keys).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    if start is not None:
        spans = spans.withColumn("_lo", s.position(F.lit(start).cast("timestamp")))
    if end is not None:
        spans = spans.withColumn("_hi", s.position(F.lit(end).cast("timestamp")))
    spans = spans.where(F.col("_lo") <= F.col("_hi"))
    return grid_slots(spans, s, "_lo", "_hi").join(df, [*s.keys, s.ts], "left")


def future_grid(df: DataFrame, s: Series, n: int) -> DataFrame:
    """The next ``n`` slots after the last row of each series."""
    last = df.groupBy(*s.keys).agg(F.max(s.position()).alias("_hi"))
    spans = last.select(
        *s.keys, (F.col("_hi") + 1).alias("_a"), (F.col("_hi") + n).alias("_b")
    )
    return grid_slots(spans, s, "_a", "_b")


def ffill(
    df: DataFrame,
    s: Series,
    cols: Sequence[str],
    limit: int | None = None,
    fill: float | None = None,
) -> DataFrame:
    """Forward fill along a dense grid, at most ``limit`` rows, then a constant."""
    if limit is None:
        cut = spread(df, s)
        kept = [c for c in df.columns if c not in cols]
        out = last_known(
            cut.withColumnsRenamed({c: f"_raw_{c}" for c in cols}),
            s,
            {c: F.col(f"_raw_{c}") for c in cols},
        ).select(*kept, *cols)
    else:
        cut = spread(df, s, back=limit)
        w = s.frame(-limit)
        out = cut.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
        out = out.where(F.col(BLK) == s.home)
    out = out.select(*df.columns)
    return out if fill is None else out.na.fill(fill, list(cols))


def upsample(df: DataFrame, s: Series, cols: Sequence[str], limit: int | None = 4) -> DataFrame:
    """Coarser series onto the grid of ``s``: dense slots, then a bounded fill."""
    return ffill(densify(df, s), s, cols, limit=limit)


#: Amounts are added up as whole numbers of this part of a unit, so sums are exact.
UNIT = 1_000_000


def expand_intervals(
    iv: DataFrame,
    s: Series,
    amount: str,
    start: str,
    end: str,
    grid_start: str,
    grid_end: str,
    parts: Mapping[str, Column],
    unit: int = UNIT,
) -> DataFrame:
    """Per grid slot the total ``amount`` of the intervals [start, end) covering it.

    ``parts`` names each total and the rows it counts.  Each interval becomes a step up at
    its first slot and a step down after its last one, in whole parts of a unit (one
    ``unit``-th), and the running sum of the steps is the covering total: no interval is
    expanded, and what was added goes away again to the last digit.  The grid is built
    once, block by block; a block begins with the sum of the steps in earlier blocks.
    Keys whose intervals all lie outside the grid have zeros.
    """
    first = s.position(F.lit(grid_start).cast("timestamp"))
    last = s.position(F.lit(grid_end).cast("timestamp"))
    ceil = lambda c: F.ceil(F.unix_micros(F.col(c)) / F.lit(s.step * 1_000_000)).cast("long")
    whole = F.coalesce(F.round(F.col(amount) * unit), F.lit(0)).cast("long")
    spans = iv.select(
        *s.keys,
        F.greatest(ceil(start), first).alias("_a"),
        F.least(ceil(end), last + 1).alias("_b"),
        *[F.when(c, whole).otherwise(F.lit(0)).alias(f"_v_{n}") for n, c in parts.items()],
    )
    # An interval outside the grid still names its key.
    inside = F.coalesce(F.col("_a") < F.col("_b"), F.lit(False))
    up = F.struct(F.when(inside, F.col("_a")).otherwise(first).alias(POS), inside.cast("int").alias("_s"))
    down = F.struct(F.col("_b").alias(POS), F.lit(-1).alias("_s"))
    edges = spans.select("*", F.explode(F.when(inside, F.array(up, down)).otherwise(F.array(up))).alias("_e"))
    steps = edges.groupBy(*s.keys, F.col(f"_e.{POS}").alias(POS)).agg(
        *[F.sum(F.col(f"_v_{n}") * F.col("_e._s")).alias(f"_d_{n}") for n in parts]
    )
    steps = steps.withColumn(BLK, s.home)
    rows = F.lit(s.rows)
    blocks = steps.select(*s.keys).distinct().withColumn(
        BLK, F.explode(F.sequence(F.floor(first / rows), F.floor(last / rows)))
    )
    within = steps.groupBy(*s.keys, BLK).agg(*[F.sum(f"_d_{n}").alias(f"_d_{n}") for n in parts])
    before = Window.partitionBy(*s.keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    entering = blocks.join(within, [*s.keys, BLK], "left").select(
        *s.keys, BLK, *[F.coalesce(F.sum(f"_d_{n}").over(before), F.lit(0)).alias(f"_in_{n}") for n in parts]
    )
    slots = F.sequence(F.greatest(first, F.col(BLK) * rows), F.least(last, (F.col(BLK) + 1) * rows - 1))
    grid = entering.withColumn(POS, F.explode(slots))
    totals = grid.join(steps.drop(BLK), [*s.keys, POS], "left")
    so_far = lambda n: F.coalesce(F.sum(f"_d_{n}").over(s.upto), F.lit(0)) + F.col(f"_in_{n}")
    return totals.select(*s.keys, s.time_of(F.col(POS)).alias(s.ts), *[(so_far(n) / unit).alias(n) for n in parts])


def dedup(
    df: DataFrame, key: Sequence[str], order: Sequence[str], keep: str = "first"
) -> DataFrame:
    """One row per key: the smallest (or largest) by the named order columns.

    Min/max of a struct is combined before the shuffle, so a key with very many
    copies never gathers in one task.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    row = F.struct(*order, *rest)
    pick = F.min(row) if keep == "first" else F.max(row)
    return df.groupBy(*key).agg(pick.alias("_r")).select(*key, "_r.*").select(*df.columns)


def latest_revision(df: DataFrame, id_col: str, rev: str) -> DataFrame:
    """Rows of the highest revision of each id; ties stay."""
    top = df.groupBy(id_col).agg(F.max(rev).alias(rev))
    return df.join(top, [id_col, rev], "left_semi")


def net_series(exports: DataFrame, imports: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Export minus import over the union of their times (see ``net_of``)."""
    from gridtide.functions.scalars import net_of

    e = exports.withColumnRenamed(name, "_e")
    i = imports.withColumnRenamed(name, "_i")
    return e.join(i, list(on), "full_outer").select(*on, net_of("_e", "_i").alias(name))


def pivot_wide(
    df: DataFrame, on: Sequence[str], dim: str, value: str, values: Sequence[str], name: str
) -> DataFrame:
    """Long to wide over a given value list; ``name`` formats the column names."""
    wide = df.groupBy(*on).pivot(dim, list(values)).agg(F.first(value))
    return wide.withColumnsRenamed({v: name.format(v.lower()) for v in values})


def overlay(a: DataFrame, b: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Keep the value of ``a``, else that of ``b``; columns absent in ``a`` are added."""
    other = b.select(*on, *[F.col(c).alias(f"_b_{c}") for c in cols])
    out = a.join(other, list(on), "left")
    return out.withColumns(
        {
            c: F.coalesce(F.col(c), F.col(f"_b_{c}")) if c in a.columns else F.col(f"_b_{c}")
            for c in cols
        }
    ).drop(*[f"_b_{c}" for c in cols])


def fill_median(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Replace missing values by the exact median of the column (one per key)."""
    found = stacked_percentiles(df, list(keys), list(cols), {"_med": 0.5})
    wide = found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("column_name") == c, F.col("_med"))).alias(f"_med_{i}") for i, c in enumerate(cols)]
    )
    out = attach(df, wide, keys, "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"_med_{i}")) for i, c in enumerate(cols)}
    return out.withColumns(filled).drop(*[f"_med_{i}" for i in range(len(cols))])


def interior_gaps(df: DataFrame, s: Series) -> DataFrame:
    """Holes inside a series: last slot before, first slot after, missing slots."""
    cut = spread(df.select(*s.keys, s.ts).distinct(), s)
    seen = cut.withColumn("_prev", F.lag(POS).over(s.over))
    # The first row of a block has no neighbour inside it; its predecessor is the
    # last slot of the blocks before, which the carry holds.
    carry = seen.join(_tails(cut, s), [*s.keys, BLK])
    prev = F.coalesce(F.col("_prev"), F.col("_before"))
    return (
        carry.withColumn("_p", prev)
        .where(F.col(POS) - F.col("_p") > 1)
        .select(
            *s.keys,
            s.time_of(F.col("_p")).alias("gap_after"),
            F.col(s.ts).alias("gap_before"),
            (F.col(POS) - F.col("_p") - 1).alias("missing"),
        )
    )


def _tails(cut: DataFrame, s: Series) -> DataFrame:
    before = Window.partitionBy(*s.keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    tail = cut.groupBy(*s.keys, BLK).agg(F.max(POS).alias("_m"))
    return tail.select(*s.keys, BLK, F.max("_m").over(before).alias("_before"))
