"""As-of, snapshot and nearest joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.operators.blocks import BLK, attach
from gridtide.operators.quantiles import bucket_of

# Times of one key that a sweep puts into one task, about.
SWEEP_ROWS = 50_000
SWEEP_CUTS = 256  # quantiles of a key's times that the cuts are taken from


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c))


def _blocked(times: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``times`` (keys, _t) with time blocks of about ``rows`` times each, whatever their
    distribution: a key is cut at quantiles of its own times (from a bounded sketch), at
    as many as its size asks for.  Between quantiles of a key with more than
    ``SWEEP_CUTS`` blocks, blocks are of equal length."""
    probes = ", ".join(f"{k / SWEEP_CUTS!r}D" for k in range(1, SWEEP_CUTS))
    cuts = F.expr(f"array_distinct(approx_percentile(_t, array({probes}), {20 * SWEEP_CUTS}))")
    size = times.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), cuts.alias("_cuts"), F.min("_t").alias("_lo"), (F.max("_t") + 1).alias("_hi")
    )
    wanted = F.ceil(F.col("_n") / rows)
    every = F.greatest(F.lit(1), F.floor(F.lit(SWEEP_CUTS) / wanted)).cast("int")
    kept = F.filter("_cuts", lambda _, i: (i + 1) % F.col("_every") == 0)
    size = size.withColumn("_every", every).select(
        *keys, kept.alias("_cuts"), F.greatest(F.lit(1), F.ceil(wanted / SWEEP_CUTS)).alias("_pieces"), "_lo", "_hi"
    )
    # Blocks are numbered cut by cut; a cut's times go to its pieces by their place in it.
    cut = bucket_of(F.col("_t"), F.col("_cuts"), SWEEP_CUTS)
    low = F.coalesce(F.when(cut > 0, F.try_element_at("_cuts", cut)), F.col("_lo"))
    high = F.coalesce(F.try_element_at("_cuts", cut + 1), F.col("_hi"))
    piece = F.floor((F.col("_t") - low) * F.col("_pieces") / F.greatest(high - low, F.lit(1)))
    block = cut * F.col("_pieces") + F.least(piece, F.col("_pieces") - 1)
    return attach(times, size, keys).withColumn(BLK, block.cast("long")).drop("_cuts", "_pieces", "_lo", "_hi")


def latest_before(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    name: str,
    rows: int = SWEEP_ROWS,
) -> DataFrame:
    """(keys, left_ts, name): for each distinct left time the largest right time at or
    before it.

    Both sides are reduced to distinct times, merged and swept once per (keys, time
    block); the best right time of earlier blocks is carried in.  No inequality join.
    """
    # A right row sorts before a left row of the same instant.
    r = right.select(*keys, _micros(right_ts).alias("_t")).distinct().withColumn("_left", F.lit(0))
    l = left.select(*keys, _micros(left_ts).alias("_t")).distinct().withColumn("_left", F.lit(1))
    both = _blocked(r.unionByName(l), keys, rows)
    mark = F.when(F.col("_left") == 0, F.col("_t"))
    w = Window.partitionBy(*keys, BLK).orderBy("_t", "_left")
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    tail = both.groupBy(*keys, BLK).agg(F.max(mark).alias("_m"))
    tail = tail.select(*keys, BLK, F.max("_m").over(before).alias("_in"))
    swept = both.withColumn("_hit", F.max(mark).over(w)).join(tail, [*keys, BLK])
    return swept.where(F.col("_left") == 1).select(
        *keys,
        F.timestamp_micros("_t").alias(left_ts),
        F.timestamp_micros(F.coalesce("_hit", "_in")).alias(name),
    )


def asof_run(
    actual: DataFrame,
    runs: DataFrame,
    keys: Sequence[str] = ("zone",),
    ts: str = "ts",
    run: str = "generated_at",
) -> DataFrame:
    """Each actual row with the forecast of the newest run made at or before it;
    NULLs where that run does not cover the time."""
    which = latest_before(actual, runs.select(*keys, run), keys, ts, run, run)
    return actual.join(which, [*keys, ts], "left").join(runs, [*keys, ts, run], "left")


def asof_row(
    actual: DataFrame,
    runs: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = ("zone",),
    ts: str = "ts",
    run: str = "generated_at",
    how: str = "left",
) -> DataFrame:
    """Each actual row with the newest forecast row for its time that was made at or
    before it; different times may come from different runs."""
    best = runs.where(F.col(run) <= F.col(ts)).groupBy(*keys, ts).agg(
        *[F.max_by(c, run).alias(c) for c in cols], F.max(run).alias(run)
    )
    return actual.join(best, [*keys, ts], how)


def latest_run(
    runs: DataFrame, keys: Sequence[str] = ("zone",), run: str = "generated_at"
) -> DataFrame:
    """Rows of the newest run of each key."""
    top = runs.groupBy(*keys).agg(F.max(run).alias(run))
    return runs.join(top, [*keys, run], "left_semi")


def nearest(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    keys: Sequence[str] = ("zone",),
    ts: str = "ts",
    rows: int = SWEEP_ROWS,
) -> DataFrame:
    """Values of the right row closest in time; the earlier one on equal distance.

    One sweep gives the neighbour before and the neighbour after each left time.
    """
    row = F.struct(F.col("_t").alias("t"), *values)
    r = right.select(*keys, _micros(ts).alias("_t"), *values)
    # One row per right time; which of several equal times is kept is fixed by order.
    r = r.groupBy(*keys, "_t").agg(F.min(F.struct(*values)).alias("_v")).select(*keys, "_t", "_v.*")
    r = r.select(*keys, "_t", row.alias("_row"))
    l = left.select(*keys, _micros(ts).alias("_t")).distinct()
    both = _blocked(r.unionByName(l, allowMissingColumns=True), keys, rows)
    # Both frames grow from their start, so each row costs the same: the rows still to
    # come are read in falling time order.
    w = Window.partitionBy(*keys, BLK)
    upto = (Window.unboundedPreceding, Window.currentRow)
    past = w.orderBy(F.col("_t").asc()).rangeBetween(*upto)
    coming = w.orderBy(F.col("_t").desc()).rangeBetween(*upto)
    ends = both.groupBy(*keys, BLK).agg(F.max("_row").alias("_hi"), F.min("_row").alias("_lo"))
    by = Window.partitionBy(*keys).orderBy(BLK)
    ends = ends.select(
        *keys,
        BLK,
        F.max("_hi").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.min("_lo").over(by.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    swept = (
        both.withColumns({"_p": F.max("_row").over(past), "_n": F.min("_row").over(coming)})
        .where(F.col("_row").isNull())
        .join(ends, [*keys, BLK])
    )
    p = F.coalesce("_p", "_before")
    n = F.coalesce("_n", "_after")
    pick = F.when(
        n.isNull() | (F.col("_t") - p["t"] <= n["t"] - F.col("_t")), p
    ).otherwise(n)
    found = swept.select(*keys, F.timestamp_micros("_t").alias(ts), pick.alias("_pick"))
    found = found.select(*keys, ts, *[F.col(f"_pick.{v}").alias(v) for v in values])
    return left.join(found, [*keys, ts], "left")


def run_history(
    hist: DataFrame,
    runs: DataFrame,
    span_seconds: int,
    keys: Sequence[str] = ("zone",),
    ts: str = "ts",
    run: str = "generated_at",
) -> DataFrame:
    """History rows of each run: ``run - span < ts <= run``.

    Both sides carry time buckets as long as the span, so a history row meets only
    the runs of its own and the next bucket through an equi join.
    """
    size = F.lit(span_seconds * 1_000_000)
    b = F.floor(_micros(ts) / size).cast("long")
    h = hist.withColumn("_b", F.explode(F.array(b, b + 1)))
    r = runs.select(*keys, run).distinct()
    r = r.withColumn("_b", F.floor(_micros(run) / size).cast("long"))
    out = h.join(r, [*keys, "_b"])
    age = _micros(run) - _micros(ts)
    return out.where((age >= 0) & (age < size)).drop("_b")


def left_fill(
    df: DataFrame, other: DataFrame, s, cols: Sequence[str], limit: int = 3
) -> DataFrame:
    """Left join on the series key, then a bounded forward fill of the new columns."""
    from gridtide.operators.grid import ffill

    return ffill(df.join(other, [*s.keys, s.ts], "left"), s, cols, limit=limit)


def outer_align(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Full outer join of several series on their key."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(on), "full_outer")
    return out
