"""Read-side tables: snapshots, pages and reports as DataFrames.

``now`` is always an argument (a timestamp Column), so a report can be repeated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions import calendar as cal
from gridtide.functions.scalars import age_band, age_label, title_case, zscore_class
from gridtide.operators import aggregates, projections, windows
from gridtide.operators.blocks import QUARTER, Series, attach
from gridtide.operators.joins import asof_row, latest_run
from gridtide.plans import evaluate

KEYS = ("zone",)


def recent_prices(prices: DataFrame, n: int = 24, keys: Sequence[str] = KEYS) -> DataFrame:
    return projections.latest_per(prices, n, keys)


recent_weather = recent_prices


def forecast_now(runs: DataFrame, prices: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of the newest run beside the newest known price and their difference."""
    last = projections.last_row(prices, keys).select(
        *keys, F.col("ts").alias("actual_ts"), F.col("price_eur_mwh").alias("actual_price")
    )
    out = latest_run(runs, keys).join(last, list(keys), "left")
    return out.withColumn("forecast_vs_current_delta", F.col("p50") - F.col("actual_price"))


def price_snapshot(prices: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Newest price of each series against its last day and week, with the peak of the
    last two days (rows, as stored)."""
    w = Window.partitionBy(*keys).orderBy(F.col("ts").desc())
    recent = prices.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 168)
    p, rn = F.col("price_eur_mwh"), F.col("_rn")
    day, two = F.when(rn <= 24, p), F.when(rn <= 48, p)
    peak = F.when((rn <= 48) & p.isNotNull(), F.struct(p, -F.unix_micros("ts")))
    out = recent.groupBy(*keys).agg(
        F.max("ts").alias("ts"),
        F.max_by(p, F.col("ts")).alias("current_price"),
        F.avg(day).alias("avg_24h"), F.min(day).alias("min_24h"), F.max(day).alias("max_24h"),
        F.avg(p).alias("mean_7d"), F.stddev_samp(p).alias("std_7d"),
        F.max(two).alias("peak_48h"), F.max_by("ts", peak).alias("peak_ts"),
    )
    z = F.when(F.col("std_7d") > 0, (F.col("current_price") - F.col("mean_7d")) / F.col("std_7d"))
    out = out.withColumn("z_score", F.coalesce(z, F.lit(0.0)))
    return out.withColumn("anomaly", zscore_class("z_score"))


def price_series(prices: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    return projections.lookback(prices, hours * 3600, now)


def forecast_snapshot(
    runs: DataFrame, prices: DataFrame, now: Column, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Next hour and 12-hour mean of the newest run at hand, and the accuracy of the
    last 24 hours against forecasts made in time."""
    made = runs.where(F.col("generated_at") <= now)
    nxt = projections.upcoming(made, now, 12, keys)
    first = lambda c: F.min_by(c, "ts").alias(f"next_{c}")
    head = nxt.groupBy(*keys).agg(
        first("p05"), first("p50"), first("p95"), F.avg("p50").alias("avg_p50_12h")
    )
    day = projections.lookback(prices, 24 * 3600, now).where(F.col("ts") < now)
    scored = asof_row(day.withColumnRenamed("price_eur_mwh", "y"), runs, ["p50"], keys, how="inner")
    return head.join(evaluate.accuracy(scored, keys), list(keys), "left")


def forecast_series(runs: DataFrame, now: Column, n: int = 48, keys: Sequence[str] = KEYS) -> DataFrame:
    return projections.upcoming(runs.where(F.col("generated_at") <= now), now, n, keys)


def weather_snapshot(view: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return projections.last_row(view, keys)


def forecast_page(
    runs: DataFrame, now: Column, keys: Sequence[str] = KEYS, tz: str = cal.LOCAL_ZONE
) -> tuple[DataFrame, DataFrame]:
    """Card and table of the newest run from the current hour on."""
    valid = projections.still_valid(latest_run(runs, keys), now)
    return aggregates.forecast_card(valid, tz=tz, by=keys), valid


def last_valid(df: DataFrame, c: str, now: DataFrame, keys=KEYS, ts: str = "ts") -> DataFrame:
    """Newest known value of each series with its age at ``now`` (a one-row frame
    with the column ``_now``)."""
    known = F.when(F.col(c).isNotNull(), F.col(ts))
    last = df.groupBy(*keys).agg(F.max_by(c, known).alias(c), F.max(known).alias(ts))
    age = ((F.unix_seconds("_now") - F.unix_seconds(ts)) / 60).cast("long")
    out = attach(last, now, []).withColumn("age_minutes", age)
    return out.withColumn("age", age_label("age_minutes")).drop("_now")


def status_table(
    fc: DataFrame, actual: DataFrame, now: Column, value: str, keys: Sequence[str] = KEYS,
    tz: str = cal.LOCAL_ZONE,
) -> DataFrame:
    """Forecast rows with the actual as text: the value, "pending", or a dash for the
    future."""
    got = actual.select(*keys, "ts", F.col(value).alias("_a"))
    # The tiny shift keeps values midway between two texts from depending on noise.
    text = (
        F.when(F.col("_a").isNotNull(), F.format_string("%.1f", F.round(F.col("_a") + 1e-9, 1)))
        .when(F.col("ts") > now, F.lit("—"))
        .otherwise(F.lit("pending"))
    )
    out = fc.join(got, [*keys, "ts"], "left").withColumn("actual", text).drop("_a")
    out = out.withColumn("time", F.date_format(cal.local("ts", tz), "dd MMM HH:mm"))
    if "regime" in fc.columns:
        out = out.withColumn("regime_label", F.coalesce(title_case("regime"), F.lit("—")))
    return out


def imbalance_page(
    actual: DataFrame, runs: DataFrame, now: Column, s: Series = QUARTER
) -> dict[str, DataFrame]:
    """Everything one page shows: settled price, next slot, 48 h of actuals, the run's
    first 96 rows with status and regime segments, and the week's direction split."""
    keys = s.keys
    now_frame = actual.sparkSession.range(1).select(now.alias("_now"))
    run = latest_run(runs, keys)
    first = Window.partitionBy(*keys).orderBy("ts")
    head = run.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= 96).drop("_rn")
    week = projections.lookback(actual, 168 * 3600, now)
    nxt = projections.upcoming(runs, now, 1, keys)
    return {
        "settled": last_valid(week, "imbl_price", now_frame, keys),
        "next": nxt.select(*keys, "ts", "p50", "spike_proba", "regime"),
        "actuals": projections.lookback(actual, 48 * 3600, now),
        "forecast": status_table(head, actual, now, "imbl_price", keys),
        "segments": windows.segments(head, s, "regime"),
        "direction": aggregates.direction_split(week, "direction", keys),
    }


def performance(scored: DataFrame, tz: str = cal.LOCAL_ZONE) -> tuple[DataFrame, DataFrame]:
    return evaluate.eval_spot(scored, tz=tz), aggregates.mae_by_hour(scored, "y", "p50", tz=tz)


def backtest(scored: DataFrame, first: str, last: str, tz: str = cal.LOCAL_ZONE) -> dict[str, DataFrame]:
    """Card, daily error, error histogram, error by hour and price distribution of the
    local days first..last."""
    rows = projections.local_days(scored, first, last, tz=tz)
    err = evaluate.residuals(rows)
    return {
        "card": evaluate.backtest_spot(rows),
        "daily": aggregates.daily_mae(rows, "y", "p50", tz=tz),
        "histogram": aggregates.histogram(err, "residual", 40),
        "by_hour": aggregates.mae_by_hour(rows, "y", "p50", tz=tz),
        "distribution": aggregates.price_distribution(rows, "y"),
    }


def explore(df: DataFrame, start: str, end: str, c: str, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Rows of a range and the summary of one of their columns."""
    rows = projections.between(df, start, end)
    return rows, aggregates.stats(rows, c, keys)


def freshness(runs: Mapping[str, DataFrame], now: Column, run: str = "generated_at") -> DataFrame:
    """Age, band and label of the newest run of each forecast table."""
    last = [
        df.agg(F.max(run).alias("generated_at")).select(F.lit(n).alias("table_name"), "generated_at")
        for n, df in runs.items()
    ]
    out = reduce(DataFrame.unionByName, last)
    age = ((F.unix_seconds(now) - F.unix_seconds("generated_at")) / 60).cast("long")
    out = out.withColumn("age_minutes", age)
    return out.withColumns({"band": age_band("age_minutes"), "label": age_label("age_minutes")})


def decisions(log: DataFrame, n: int = 20) -> DataFrame:
    """The newest decisions, newest first."""
    return log.orderBy(F.col("ts").desc()).limit(n)


# The column groups whose coverage is reported.
SOURCE_GROUPS = {
    "imbalance": ["imbl_price", "direction", "imbl_spot_diff"],
    "weather": ["temperature", "windspeed_100m", "cloudcover"],
    "spot": ["spot_price"],
    "fcst_hist": ["fcst_wind_100m", "fcst_wind_10m"],
    "smhi_fcst_ovlay": ["fcst_wind_gust", "fcst_precip_prob"],
    "smhi_analysis": ["mesan_wind_speed", "mesan_cloud_fraction"],
    "nuclear": ["nuclear_unavail_mw", "nuclear_outage_flag"],
    "gen_forecast": ["wind_gen_forecast_mw", "solar_gen_forecast_mw"],
    "flows": ["net_position_mw"],
}


def source_coverage(master: DataFrame) -> DataFrame:
    return aggregates.null_report(master, SOURCE_GROUPS)
