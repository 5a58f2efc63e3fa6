"""Scores, curves and threshold rules over frames of labelled predictions.

Regression frames hold (ts, y, p05, p50, p95[, lag1]); spike frames (score, label).
Every function takes ``by`` and returns one row per group (or per group and point).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions import calendar as cal
from gridtide.functions.scalars import accuracy_rating, clip, is_spike
from gridtide.operators.blocks import attach
from gridtide.operators.quantiles import bucket_of, exact_percentiles, ranked_values

# Economics and guard rails of the spike threshold.
COST_FP = 15.0
COST_FN = 300.0
SLOT_HOURS = 0.25
PROFIT_CAP = 5000.0
PROFIT_GRID = [float(x) for x in np.linspace(0.01, 0.99, 100)]
SWEEP_GRID = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
THRESHOLD_MIN, THRESHOLD_MAX, MAX_CHANGE = 0.10, 0.95, 0.15
MAX_F2_LOSS, NO_CHANGE, KEEP_F2, KEEP_RECALL = 0.05, 0.01, 0.30, 0.40


def _share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def _err(y: str = "y", yhat: str = "p50") -> Column:
    return F.col(yhat) - F.col(y)


def in_band(y: str = "y") -> Column:
    return (F.col(y) >= F.col("p05")) & (F.col(y) <= F.col("p95"))


def eval_spot(df: DataFrame, ts: str = "ts", tz: str = cal.LOCAL_ZONE, by: Sequence[str] = ()) -> DataFrame:
    """Day-ahead card: errors overall, at night, at peak and on spikes, and coverage.

    The relative error leaves out prices within 10 of zero.
    """
    y, a = F.col("y"), F.abs(_err())
    night, peak = cal.in_hours(ts, cal.NIGHT_HOURS, tz), cal.in_hours(ts, cal.PEAK_HOURS, tz)
    return df.groupBy(*by).agg(
        F.count("y").alias("n"),
        F.avg(a).alias("mae"),
        F.sqrt(F.avg(a * a)).alias("rmse"),
        (100 * F.avg(F.when(F.abs(y) > 10, a / F.abs(y)))).alias("mape"),
        (100 * _share(in_band())).alias("coverage"),
        F.avg(F.when(night, a)).alias("night_mae"),
        F.avg(F.when(peak, a)).alias("peak_mae"),
        F.count_if(y > 100).alias("n_spikes"),
        F.avg(F.when(y > 100, a)).alias("spike_mae"),
    )


def _agreement(yhat: str, y: str = "y", now: str = "lag1") -> Column:
    """Share of rows whose predicted step from the known price has the right sign,
    where neither step is zero."""
    p, t = F.sign(F.col(yhat) - F.col(now)), F.sign(F.col(y) - F.col(now))
    return F.avg(F.when((p != 0) & (t != 0), (p == t).cast("double")))


def eval_imbalance(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    a = F.abs(_err())
    naive = F.avg(F.abs(F.col("y") - F.col("lag1")))
    return df.groupBy(*by).agg(
        F.count("y").alias("n"),
        F.avg(a).alias("mae"),
        F.sqrt(F.avg(a * a)).alias("rmse"),
        (100 * _share(in_band())).alias("coverage"),
        (1 - F.avg(a) / F.nullif(naive, F.lit(0.0))).alias("skill"),
        _agreement("p50").alias("direction_accuracy"),
    )


def eval_baselines(df: DataFrame, predictions: Mapping[str, str], min_rows: int = 0) -> DataFrame:
    """Errors of several prediction columns side by side; those with too few rows are
    left out."""
    rows = F.array(
        *[F.struct(F.lit(n).alias("baseline"), F.col(c).alias("_p")) for n, c in predictions.items()]
    )
    long = df.select("y", "lag1", F.inline(rows)).where(F.col("_p").isNotNull())
    e = F.abs(F.col("_p") - F.col("y"))
    out = long.groupBy("baseline").agg(
        F.count("y").alias("n"),
        F.avg(e).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        _agreement("_p").alias("direction_accuracy"),
    )
    return out.where(F.col("n") > min_rows)


# --- curves over scores -------------------------------------------------------


def score_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, from the highest down: positives and negatives at it (pos,
    neg), reached so far (tp, fp), and in all (all_pos, all_neg).

    Rows collapse to distinct scores before anything is sorted, and the running sums
    go by score buckets, so neither ties nor a large test set fill one task.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"),
        F.sum((1 - F.col(label)).cast("bigint")).alias("neg"),
    )
    total = counts.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    curve = ranked_values(
        counts, by, score, {"tp": F.col("pos"), "fp": F.col("neg")}, ascending=False
    )
    return attach(curve, total, by)


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve; ties count half.  NULL without both classes."""
    c = score_curve(df, score, label, by)
    won = F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2)
    pairs = F.max(F.col("all_pos") * F.col("all_neg"))
    return c.groupBy(*by).agg((F.sum(won) / F.nullif(pairs, F.lit(0))).alias("auc"))


def _f2(p: Column, r: Column, floor: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(5 * p * r, 4 * p + r + floor), F.lit(0.0))


def pr_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, precision, recall, f2) at each distinct score."""
    c = score_curve(df, score, label, by)
    c = c.withColumns(
        {
            "precision": F.col("tp") / (F.col("tp") + F.col("fp")),
            "recall": F.coalesce(F.try_divide("tp", "all_pos"), F.lit(0.0)),
        }
    )
    return c.select(
        *by, F.col(score).alias("threshold"), "precision", "recall",
        _f2(F.col("precision"), F.col("recall"), 1e-9).alias("f2"),
    )


def best_f2(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """The threshold of the highest F2, the lowest such threshold on a tie."""
    c = pr_curve(df, score, label, by)
    key = F.struct(F.col("f2"), -F.col("threshold"))
    return c.groupBy(*by).agg(F.max_by("threshold", key).alias("threshold"), F.max("f2").alias("f2"))


def roc_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    c = score_curve(df, score, label, by)
    return c.select(
        *by, F.col(score).alias("threshold"),
        F.try_divide("fp", "all_neg").alias("fpr"), F.try_divide("tp", "all_pos").alias("tpr"),
    )


def nearest_point(curve: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """The curve point whose threshold is closest to a wanted one, the lower on a tie."""
    key = F.struct(F.abs(F.col("threshold") - threshold), F.col("threshold"))
    cols = [c for c in curve.columns if c not in by]
    return curve.groupBy(*by).agg(*[F.min_by(c, key).alias(c) for c in cols])


def _at_thresholds(
    df: DataFrame, score: str, grid: Sequence[float], sums: Mapping[str, Column],
    by: Sequence[str], strict: bool,
) -> DataFrame:
    """(by, threshold, sums over the rows at or above each threshold).

    Each row falls once into the step of the grid it reaches; suffix sums over the
    few steps replace a pass per threshold.
    """
    bounds = F.array(*[F.lit(float(t)) for t in grid])
    step = bucket_of(F.coalesce(F.col(score), F.lit(-1.0)), bounds, len(grid), strict)
    hits = df.withColumn("_k", step).groupBy(*by, "_k").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    steps = F.explode(F.sequence(F.lit(0), F.lit(len(grid)))).alias("_k")
    groups = hits.select(*by).distinct() if by else df.sparkSession.range(1)
    full = groups.select(*by, steps).join(hits, [*by, "_k"], "left")
    w = Window.partitionBy(*by).orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = full.select(*by, "_k", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums])
    return out.where(F.col("_k") > 0).select(
        *by, F.element_at(bounds, F.col("_k")).alias("threshold"), *sums
    )


def profit_curve(
    df: DataFrame, score: str, label: str, price: str,
    grid: Sequence[float] = tuple(PROFIT_GRID), by: Sequence[str] = (),
) -> DataFrame:
    """Profit per threshold: the capped price of the spikes caught, less the cost of
    false alarms, both for the hours of a slot."""
    won = clip(price, 0.0, PROFIT_CAP) * SLOT_HOURS
    hit = F.col(label) == 1
    sums = {
        "_won": F.when(hit, won).otherwise(0.0),
        "_false": F.when(hit, 0.0).otherwise(COST_FP * SLOT_HOURS),
    }
    c = _at_thresholds(df, score, grid, sums, by, strict=False)
    return c.select(*by, "threshold", (F.col("_won") - F.col("_false")).alias("profit"))


def profit_threshold(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The most profitable threshold, the lowest on a tie."""
    key = F.struct(F.round("profit", 6), -F.col("threshold"))
    return curve.groupBy(*by).agg(
        F.max_by("threshold", key).alias("threshold"), F.max("profit").alias("profit")
    )


def _count(cond: Column) -> Column:
    return cond.cast("bigint")


def threshold_sweep(
    df: DataFrame, score: str, label: str,
    grid: Sequence[float] = tuple(SWEEP_GRID), by: Sequence[str] = (), strict: bool = True,
) -> DataFrame:
    """Recall, precision, F2 and alarms per threshold (3 places, as reported)."""
    pos = F.col(label) == 1
    total = df.groupBy(*by).agg(F.sum(_count(pos)).alias("_pos"))
    c = _at_thresholds(
        df, score, grid, {"_tp": _count(pos), "n_predicted": F.lit(1).cast("bigint")}, by, strict
    )
    c = attach(c, total, by)
    c = c.withColumns(
        {
            "_r": F.col("_tp") / F.greatest(F.col("_pos"), F.lit(1)),
            "_p": F.col("_tp") / F.greatest(F.col("n_predicted"), F.lit(1)),
        }
    )
    f2 = 5 * F.col("_p") * F.col("_r") / F.greatest(4 * F.col("_p") + F.col("_r"), F.lit(1e-9))
    return c.select(
        *by, "threshold", F.round("_r", 3).alias("recall"), F.round("_p", 3).alias("precision"),
        F.round(f2, 3).alias("f2"), "n_predicted",
    )


def best_of_sweep(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    key = F.struct(F.col("f2"), -F.col("threshold"))
    return sweep.groupBy(*by).agg(
        F.max_by("threshold", key).alias("best_threshold"), F.max("f2").alias("best_f2")
    )


def confusion(df: DataFrame, score: str, label: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts per (label, predicted) and their share of the label's rows."""
    hat = (F.col(score) >= threshold).cast("int")
    c = df.groupBy(*by, F.col(label).alias("y"), hat.alias("yhat")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by, "y")
    return c.withColumn("row_share", F.col("n") / F.sum("n").over(w))


def threshold_table(
    df: DataFrame, score: str, label: str, thresholds: Mapping[str, float | Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Recall, precision, F2, false alarms and misses at named thresholds, one pass."""
    pos = F.col(label) == 1
    aggs = []
    for n, t in thresholds.items():
        hat = F.col(score) >= t
        aggs += [
            F.count_if(pos & hat).alias(f"_tp_{n}"),
            F.count_if(~pos & hat).alias(f"_fp_{n}"),
            F.count_if(pos & ~hat).alias(f"_fn_{n}"),
        ]
    one = df.groupBy(*by).agg(*aggs)
    rows = [
        F.struct(F.lit(n).alias("name"), F.col(f"_tp_{n}").alias("tp"),
                 F.col(f"_fp_{n}").alias("fp"), F.col(f"_fn_{n}").alias("fn"))
        for n in thresholds
    ]
    out = one.select(*by, F.inline(F.array(*rows)))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = out.withColumns(
        {
            "recall": zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))),
            "precision": zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))),
        }
    )
    return out.withColumn("f2", _f2(F.col("precision"), F.col("recall")))


def cost_threshold(cost_fp: float = COST_FP, cost_fn: float = COST_FN) -> float:
    return cost_fp / (cost_fp + cost_fn)


def eval_spike(df: DataFrame, score: str, label: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    t = threshold_table(df, score, label, {"at": threshold}, by)
    out = attach(t.select(*by, "recall", "precision", "f2"), auc(df, score, label, by), by)
    return out.withColumn("threshold_used", F.lit(float(threshold)))


def score_summary(df: DataFrame, score: str, label: str) -> DataFrame:
    """Mean, median and 95th percentile of the score per class."""
    base = df.groupBy(label).agg(F.avg(score).alias("mean"), F.count(score).alias("n"))
    return base.join(exact_percentiles(df, [label], score, {"p50": 0.5, "p95": 0.95}), label, "left")


# --- backtests ------------------------------------------------------------------


def backtest_spot(joined: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Card over actuals with as-of forecasts (y, p05, p50, p95)."""
    known = F.col("p50").isNotNull() & F.col("y").isNotNull()
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("hours"),
        F.count("p50").alias("hours_with_forecast"),
        (100 * _share(F.col("p50").isNotNull())).alias("forecast_share"),
        F.avg(F.abs(_err())).alias("mae"),
        (100 * _share(F.when(known, in_band()))).alias("coverage"),
        F.avg(_err()).alias("bias"),
    )


def backtest_imbalance(
    joined: DataFrame, s, tz: str = cal.LOCAL_ZONE, threshold: float = 0.45,
    spike: Column | None = None, min_rows: int = 10,
) -> DataFrame:
    """Per series: rows, days, errors, step agreement, coverage and spike recall over
    complete rows; NULL scores where there are not more than ``min_rows`` of them."""
    from gridtide.operators.aggregates import dense_positions
    from gridtide.operators.blocks import Series
    from gridtide.operators.windows import step_agreement

    days = joined.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.datediff(F.max(cal.local_date(s.ts, tz)), F.min(cal.local_date(s.ts, tz))) + 1).alias("days"),
    )
    spike = is_spike("y") if spike is None else spike
    full = joined.where(F.col("y").isNotNull() & F.col("p50").isNotNull())
    seq = Series(keys=s.keys, ts="_seq_ts", step=1, rows=s.rows)
    ranked = dense_positions(full, s).withColumn("_seq_ts", F.timestamp_seconds("_seq"))
    ranked = step_agreement(ranked, seq, "p50", "y", "_agree")
    enough = F.count(F.lit(1)) > min_rows
    only = lambda c: F.when(enough, c)
    scores = ranked.groupBy(*s.keys).agg(
        only(F.avg(F.abs(_err()))).alias("mae"),
        only(F.sqrt(F.avg(_err() * _err()))).alias("rmse"),
        only(100 * F.avg("_agree")).alias("direction_pct"),
        only(100 * _share(in_band())).alias("coverage"),
        only(100 * F.avg(F.when(spike, (F.col("spike_proba") >= threshold).cast("double")))).alias("spike_recall"),
    )
    return days.join(scores, list(s.keys), "left")


def residuals(df: DataFrame, limit: float = 300.0) -> DataFrame:
    return df.withColumn("residual", clip(_err(), -limit, limit))


def recent_metrics(
    df: DataFrame, threshold: float, days: int, now: Column, spike: Column | None = None,
    tz: str = cal.LOCAL_ZONE, min_rows: int = 10,
) -> DataFrame:
    """Spike metrics of the trailing days over as-of scored rows (y, p05, p50, p95,
    spike_proba); no row where fewer than ``min_rows`` are at hand."""
    rows = df.where(
        (F.col("ts") >= now - F.make_dt_interval(days=F.lit(days)))
        & F.col("y").isNotNull() & F.col("p50").isNotNull()
    )
    hit = is_spike("y") if spike is None else spike
    hat = F.coalesce(F.col("spike_proba") >= threshold, F.lit(False))
    m = rows.agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.count_if(hit).alias("n_actual_spikes"),
        F.count_if(hat).alias("n_predicted"),
        F.count_if(hit & hat).alias("n_tp"),
        F.count_if(~hit & hat).alias("_fp"),
        _share(in_band()).alias("pi_coverage"),
        F.avg(F.abs(_err())).alias("mae"),
        _share(hit).alias("spike_prevalence"),
        F.avg("y").alias("mean_price"),
    ).where(F.col("n_periods") >= min_rows)
    one = F.lit(1)
    m = m.withColumns(
        {
            "recall": F.col("n_tp") / F.greatest(F.col("n_actual_spikes"), one),
            "precision": F.col("n_tp") / F.greatest(F.col("n_predicted"), one),
            "fpr": F.col("_fp") / F.greatest(F.col("n_periods") - F.col("n_actual_spikes"), one),
            "season": cal.season_name(F.month(cal.local(now, tz))),
        }
    )
    f2 = 5 * F.col("precision") * F.col("recall")
    return m.withColumn(
        "f2", f2 / F.greatest(4 * F.col("precision") + F.col("recall"), F.lit(1e-9))
    ).drop("_fp")


def recommend_threshold(sweep: DataFrame, current: float, by: Sequence[str] = ()) -> DataFrame:
    """Threshold decision from a sweep.

    Keep the current one while it performs; otherwise move to the best F2 within the
    allowed bounds and step, unless that loses F2 or hardly differs.
    """
    near_current = F.struct(F.abs(F.col("threshold") - current), F.col("threshold"))
    reachable = (
        F.col("threshold").between(THRESHOLD_MIN, THRESHOLD_MAX)
        & (F.abs(F.col("threshold") - current) <= MAX_CHANGE + 1e-9)
    )
    best = F.when(reachable, F.struct(F.col("f2"), -F.col("threshold")))
    r = sweep.groupBy(*by).agg(
        F.min_by("f2", near_current).alias("current_f2"),
        F.min_by("recall", near_current).alias("current_recall"),
        F.max_by("threshold", best).alias("candidate"),
        F.max_by("f2", best).alias("candidate_f2"),
        F.max_by("precision", best).alias("precision_val"),
        F.max_by("recall", best).alias("recall"),
    )
    keep = (F.col("current_f2") > KEEP_F2) & (F.col("current_recall") > KEEP_RECALL)
    wanted = F.when(keep | F.col("candidate").isNull(), F.lit(current)).otherwise(F.col("candidate"))
    loses = F.col("candidate_f2") < F.col("current_f2") - MAX_F2_LOSS
    same = F.abs(F.col("recommended_threshold") - current) < NO_CHANGE
    r = r.withColumn("current_threshold", F.lit(float(current))).withColumn("recommended_threshold", wanted)
    return r.withColumns(
        {
            "action": F.when(same, "no_change")
            .when(F.col("recommended_threshold") > current, "increase").otherwise("decrease"),
            "decision": F.when(same, "no_change").when(loses, "rejected").otherwise("applied"),
            "applied": F.coalesce(same | ~loses, F.lit(True)),
        }
    ).select(
        *by, "current_threshold", "recommended_threshold", "action", "decision", "applied",
        "recall", "precision_val", F.col("candidate_f2").alias("f2"),
    )


def accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and largest error, bias, rows and the rating of recent forecasts."""
    out = df.groupBy(*by).agg(
        F.avg(F.abs(_err())).alias("mean_abs_error"),
        F.max(F.abs(_err())).alias("max_abs_error"),
        F.avg(_err()).alias("bias"),
        F.count(_err()).alias("n"),
    )
    return out.withColumn("rating", accuracy_rating("mean_abs_error"))
