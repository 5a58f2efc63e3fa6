"""Summary tables.  Each is one aggregation pass unless it needs ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.functions.calendar import LOCAL_ZONE, local
from gridtide.functions.scalars import clip, is_spike, spike_class
from gridtide.operators.blocks import Series, attach, windowed
from gridtide.operators.quantiles import exact_percentiles


def share(cond: Column) -> Column:
    """Share of rows meeting a condition, over rows where it is known."""
    return F.avg(cond.cast("double"))


def stats(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(c).alias("mean"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.stddev_samp(c).alias("std"),
        F.count(c).alias("n"),
    )


def price_distribution(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, spread, extremes and the shares below 0, above 200 and 1000."""
    x = F.col(c)
    base = df.groupBy(*by).agg(
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        (100 * share(x < 0)).alias("pct_negative"),
        (100 * share(x > 200)).alias("pct_above_200"),
        (100 * share(x > 1000)).alias("pct_above_1000"),
    )
    return attach(base, exact_percentiles(df, by, c, {"median": 0.5}), by)


def mean_by(df: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(*[F.avg(c).alias(c) for c in cols])


def mode_by(df: DataFrame, key: Sequence[str], c: str) -> DataFrame:
    """Most frequent value per key, the smallest on a tie, NULL where there is none.

    Counted per (key, value) first: ``mode`` would hold a whole group's values.
    """
    counts = df.groupBy(*key, c).agg(F.count(c).alias("_n"))
    best = F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(-F.col("_n"), F.col(c))))
    return counts.groupBy(*key).agg(best.alias(c))


def direction_split(df: DataFrame, c: str, by: Sequence[str] = (), all_rows: bool = False) -> DataFrame:
    """Counts and percentages of long, neutral and short rows.

    The denominator is the non-null rows, or every row with ``all_rows``.
    """
    d = F.col(c)
    total = F.count(F.lit(1)) if all_rows else F.count(c)
    out = df.groupBy(*by).agg(
        F.count_if(d < 0).alias("n_long"),
        F.count_if(d == 0).alias("n_neutral"),
        F.count_if(d > 0).alias("n_short"),
        total.alias("n"),
    )
    pct = lambda n: 100.0 * F.col(n) / F.nullif(F.col("n"), F.lit(0))
    return out.withColumns({f"pct_{k}": pct(f"n_{k}") for k in ("long", "neutral", "short")})


def class_split(df: DataFrame, price: str) -> DataFrame:
    """Rows and share per spike class."""
    counts = df.groupBy(spike_class(price).alias("spike_class")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return attach(counts, total, []).select(
        "spike_class", "n", (F.col("n") / F.col("_all")).alias("prevalence")
    )


def mae_by_hour(df: DataFrame, y: str, yhat: str, ts: str = "ts", tz: str = LOCAL_ZONE) -> DataFrame:
    return df.groupBy(F.hour(local(ts, tz)).alias("hour")).agg(
        F.avg(F.abs(F.col(yhat) - F.col(y))).alias("mae")
    )


def daily_mae(df: DataFrame, y: str, yhat: str, ts: str = "ts", tz: str = LOCAL_ZONE) -> DataFrame:
    return df.groupBy(F.to_date(local(ts, tz)).alias("day")).agg(
        F.avg(F.abs(F.col(yhat) - F.col(y))).alias("mae")
    )


def calendar_part(part: str, ts: str = "ts", tz: str = LOCAL_ZONE) -> Column:
    t = local(ts, tz)
    return {
        "hour": lambda: F.hour(t),
        "weekday": lambda: F.weekday(t),
        "month": lambda: F.month(t),
        "month_end": lambda: F.last_day(t),
    }[part]()


def median_by(df: DataFrame, c: str, part: str, ts: str = "ts", tz: str = LOCAL_ZONE) -> DataFrame:
    """Exact median per local hour, weekday, or month (labelled by its last day)."""
    tagged = df.select(calendar_part(part, ts, tz).alias(part), c)
    return exact_percentiles(tagged, [part], c, {"median": 0.5})


def spike_rate_by(df: DataFrame, price: str, part: str, ts: str = "ts", tz: str = LOCAL_ZONE) -> DataFrame:
    """Share of spikes per local hour or month; parts without rows show 0."""
    spark = df.sparkSession
    lo, hi = {"hour": (0, 24), "weekday": (0, 7), "month": (1, 13)}[part]
    scaffold = spark.range(lo, hi).select(F.col("id").cast("int").alias(part))
    rate = df.groupBy(calendar_part(part, ts, tz).alias(part)).agg(
        share(is_spike(price)).alias("spike_rate")
    )
    return scaffold.join(rate, part, "left").na.fill(0.0, ["spike_rate"])


def percentiles(df: DataFrame, c: str, ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Long table (p, value) of interpolated percentiles."""
    names = {f"_p{k}": p for k, p in enumerate(ps)}
    wide = exact_percentiles(df, by, c, names)
    rows = F.array(
        *[F.struct(F.lit(float(p)).alias("p"), F.col(n).alias("value")) for n, p in names.items()]
    )
    return wide.select(*by, F.inline(rows))


def histogram(
    df: DataFrame,
    c: str,
    bins: int,
    by: Sequence[str] = (),
    clip_at: tuple[float, float] | None = None,
    density: bool = False,
) -> DataFrame:
    """Equal-width bins over the whole range (the top edge is closed), optionally after
    clipping to two percentiles, optionally as densities within each group."""
    x = F.col(c)
    src = df.where(x.isNotNull()).select(*by, c)
    if clip_at:
        # Values beyond the percentiles are pulled to them, as a plotting clip does.
        edge = exact_percentiles(src, [], c, {"_q0": clip_at[0], "_q1": clip_at[1]})
        src = attach(src, edge, []).select(
            *by, F.greatest(F.least(x, F.col("_q1")), F.col("_q0")).alias(c)
        )
    span = src.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    binned = attach(src, span, []).withColumn(
        "bin",
        F.when(width > 0, F.least(F.floor((x - F.col("_lo")) / width), F.lit(bins - 1)))
        .otherwise(F.lit(0))
        .cast("int"),
    )
    counts = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    groups = src.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = attach(groups, span.select("_lo", width.alias("_w")), [])
    grid = grid.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = grid.join(counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("n"),
        "_w",
    )
    if density:
        total = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
        out = attach(out, total, by).withColumn("density", F.col("n") / (F.col("_all") * F.col("_w")))
        out = out.drop("_all")
    return out.drop("_w")


def box_stats(df: DataFrame, c: str, by: Sequence[str]) -> DataFrame:
    """Quartiles and the furthest values within 1.5 interquartile ranges."""
    q = exact_percentiles(df, by, c, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    x, reach = F.col(c), 1.5 * (F.col("q3") - F.col("q1"))
    tagged = df.where(x.isNotNull()).join(q, list(by))
    return tagged.groupBy(*by).agg(
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(x >= F.col("q1") - reach, x)).alias("whisker_low"),
        F.max(F.when(x <= F.col("q3") + reach, x)).alias("whisker_high"),
        F.count(c).alias("n"),
    )


def binned_mean(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Mean of y per equal-width bin of x.  Bins are closed on the right and the lowest
    edge is lowered by 0.1 % of the range, so the smallest value lies inside."""
    src = df.where(F.col(x).isNotNull())
    span = src.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    b = F.greatest(F.ceil((F.col(x) - F.col("_lo")) / w) - 1, F.lit(0)).cast("int")
    lo = F.col("_lo") + F.col("bin") * F.col("_w")
    low = F.when(F.col("bin") == 0, lo - 0.001 * F.col("_w") * bins).otherwise(lo)
    return (
        attach(src, span, [])
        .withColumns({"bin": b, "_w": w})
        .groupBy("bin", "_lo", "_w")
        .agg(F.avg(y).alias("mean"), F.count(y).alias("n"))
        .select("bin", ((low + F.col("_lo") + (F.col("bin") + 1) * F.col("_w")) / 2).alias("center"), "mean", "n")
    )


def acf(df: DataFrame, s: Series, c: str, lags: int = 48) -> DataFrame:
    """Autocorrelation per key for lags 1..n with the +-1.96/sqrt(n) band.

    Rows without a value are dropped before lagging, so lags count values; the value
    rank serves as the slot number.  All products come from one window pass.
    """
    vals = dense_positions(df.where(F.col(c).isNotNull()).select(*s.keys, s.ts, c), s)
    seq = Series(keys=s.keys, ts="_seq_ts", step=1, rows=s.rows)
    vals = vals.withColumn("_seq_ts", F.timestamp_seconds("_seq"))
    m = vals.groupBy(*s.keys).agg(
        F.avg(c).alias("_m"), F.var_pop(c).alias("_v"), F.count(c).alias("_n")
    )
    dev = vals.join(m, list(s.keys)).withColumn("_d", F.col(c) - F.col("_m"))
    prods = windowed(
        dev.select(*s.keys, "_seq_ts", "_d", "_v", "_n"),
        seq,
        [lambda q: {f"_k{k}": F.lag("_d", k).over(q.over) for k in range(1, lags + 1)}],
        back=lags,
    )
    sums = prods.groupBy(*s.keys).agg(
        F.first("_v").alias("_v"),
        F.first("_n").alias("_n"),
        *[F.avg(F.col("_d") * F.col(f"_k{k}")).alias(f"_k{k}") for k in range(1, lags + 1)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("lag"), (F.col(f"_k{k}") / F.col("_v")).alias("acf"))
            for k in range(1, lags + 1)
        ]
    )
    return sums.select(*s.keys, F.inline(rows), (F.lit(1.96) / F.sqrt("_n")).alias("band"))


def dense_positions(df: DataFrame, s: Series) -> DataFrame:
    """Add ``_seq``, the 0-based rank in time of each row of a series: rank within a
    block plus the row counts of earlier blocks."""
    from gridtide.operators.blocks import BLK, POS, running_totals, spread

    cut = spread(df, s).withColumn("_one", F.lit(1))
    out = running_totals(cut, s.keys, BLK, [F.col(POS), F.col(s.ts)], {"_seq": F.col("_one")})
    return out.withColumn("_seq", F.col("_seq") - 1).drop(POS, BLK, "_one")


def null_report(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Coverage per group of columns: mean share of missing values, how many columns
    are more than half missing, and how many of the wanted ones exist."""
    wanted = list(dict.fromkeys(c for cs in groups.values() for c in cs if c in df.columns))
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[share(F.col(c).isNull()).alias(c) for c in wanted]
    )
    rows = []
    for g, cs in groups.items():
        have = [F.col(c) for c in cs if c in wanted]
        rows.append(
            F.struct(
                F.lit(g).alias("source"),
                F.lit(len(cs)).alias("columns"),
                F.lit(len(have)).alias("present"),
                (reduce(lambda a, b: a + b, have) / len(have) if have else F.lit(None).cast("double")).alias("null_share"),
                (reduce(lambda a, b: a + b, [(c > 0.5).cast("int") for c in have]) if have else F.lit(0)).alias("mostly_null"),
                F.col("_rows").alias("rows"),
            )
        )
    return one.select(F.inline(F.array(*rows)))


def arg_max(df: DataFrame, c: str, ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Largest value and its first time."""
    best = F.max_by(F.col(ts), F.when(F.col(c).isNotNull(), F.struct(F.col(c), -F.unix_micros(ts))))
    return df.groupBy(*by).agg(F.max(c).alias("peak"), best.alias("peak_ts"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, spread, extremes and quartiles, one row per column."""
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in cols]))
    )
    base = long.groupBy("name").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"),
    )
    q = exact_percentiles(long, ["name"], "x", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return base.join(q, "name", "left")


def first_run_date(runs: DataFrame, run: str = "generated_at", tz: str = LOCAL_ZONE) -> DataFrame:
    return runs.agg(F.min(F.to_date(local(run, tz))).alias("first_date"))


def median(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    return exact_percentiles(df, by, c, {"median": 0.5})


def forecast_card(fc: DataFrame, ts: str = "ts", tz: str = LOCAL_ZONE, by: Sequence[str] = ()) -> DataFrame:
    """Mean and peak of the median forecast, overnight low, mean half band width."""
    from gridtide.functions.calendar import OVERNIGHT_HOURS, in_hours

    first_peak = F.max_by(F.hour(local(ts, tz)), F.struct(F.col("p50"), -F.unix_micros(ts)))
    return fc.groupBy(*by).agg(
        F.avg("p50").alias("mean_p50"),
        F.max("p50").alias("max_p50"),
        first_peak.alias("max_hour"),
        F.min(F.when(in_hours(ts, OVERNIGHT_HOURS, tz), F.col("p50"))).alias("overnight_min"),
        F.avg((F.col("p95") - F.col("p05")) / 2).alias("mean_half_width"),
    )


def count_above(df: DataFrame, c: str, x: float, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(F.col(c) > x).alias("n_above"))


def display_clip(c: str, lo: float, hi: float) -> Column:
    return clip(c, lo, hi)
