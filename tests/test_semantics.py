"""Literal cases for the points where frames, SQL and Spark differ."""

import math
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridtide.features.imbalance import feature_list, imbalance_features
from gridtide.features.spot import spot_features
from gridtide.functions import calendar as cal
from gridtide.functions import scalars
from gridtide.operators import aggregates, grid, joins, projections, quantiles, windows
from gridtide.operators.blocks import HOURLY, QUARTER
from gridtide.plans import evaluate
from tests.helpers import T0, at, close, same_rows, series, values, wave_frame

UTC = timezone.utc


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_nan_is_missing(spark):
    r = one(spark, a=scalars.to_number(F.lit("NaN")), b=scalars.to_number(F.lit("x")), c=scalars.to_number(F.lit("2.5")),
            d=scalars.finite_or_zero(F.lit(float("inf"))), e=scalars.finite_or_zero(F.lit(None).cast("double")))
    assert (r.a, r.b, r.c, r.d, r.e) == (None, None, 2.5, 0.0, 0.0)


def test_clip_keeps_missing(spark):
    r = one(spark, a=scalars.clip(F.lit(None).cast("double"), 0, 5), b=scalars.clip(F.lit(9.0), 0.0, 5.0),
            c=scalars.clip(F.lit(-1.0), lower=0.0))
    assert (r.a, r.b, r.c) == (None, 5.0, 0.0)


def test_rolling_matches_pandas_windows(spark):
    x = [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0, None, 9.0]
    df = windows.rolling(series(spark, {"x": x}), QUARTER, "x", 3, ["mean", "std"], prefix="r")
    p = pd.Series(x, dtype=float).rolling(3)
    want = [None if math.isnan(v) else v for v in p.mean()]
    assert close(values(df, "r_mean"), want)
    assert close(values(df, "r_std"), [None if math.isnan(v) else v for v in p.std()])


def test_ewm_matches_pandas_with_gaps(spark):
    x = [None, 3.0, None, None, 8.0, 1.0, None, 2.0, 2.0, None]
    df = windows.ewm(series(spark, {"x": x}), QUARTER, "x", "e", 8)
    want = pd.Series(x, dtype=float).ewm(span=8, adjust=False).mean()
    assert close(values(df, "e"), [None if math.isnan(v) else v for v in want])


@pytest.mark.parametrize("limit", [3, 4, 12, None])
def test_ffill_limits(spark, limit):
    x = []
    for hole in (1, 4, 5, 13):
        x += [float(hole)] + [None] * hole
    x.append(0.0)
    df = grid.ffill(series(spark, {"x": x}), QUARTER, ["x"], limit=limit)
    want = pd.Series(x, dtype=float).ffill(limit=limit)
    assert close(values(df, "x"), [None if math.isnan(v) else v for v in want])


def test_runs_and_flips(spark):
    d = [1, 1, -1, -1, -1, 0, 1, None, None, 1]
    df = windows.streak(series(spark, {"d": d}), QUARTER, "d", "n")
    # The lagged value is missing twice at first, and missing never equals missing.
    assert values(df, "n") == [1, 1, 2, 1, 2, 3, 1, 1, 1, 1]
    f = windows.flip_counts(series(spark, {"d": d}), QUARTER, "d", [4])
    assert values(f, "flips_4")[:5] == [None, None, None, 3, 2]


def test_stress_counters(spark):
    p = [0.0, 250.0, 300.0, -260.0, 10.0, None, 210.0, 5.0]
    df = series(spark, {"p": p})
    flag = F.abs("p") > 200
    assert values(windows.run_position(df, QUARTER, flag, "n", 1), "n") == [0, 0, 0, 1, 2, 0, 0, 0]
    assert values(windows.since_last(df, QUARTER, flag, "n", 1), "n") == [1, 2, 0, 0, 0, 1, 2, 0]
    never = windows.since_last(df, QUARTER, F.col("p") > 1e6, "n", 1)
    assert values(never, "n") == list(range(1, 9))


def test_spike_class_boundaries(spark):
    p = [200.0, 200.1, 1000.0, 1000.1, -100.0, -100.1, -500.0, -500.1, None]
    df = series(spark, {"p": p}).withColumn("c", scalars.spike_class("p"))
    assert values(df, "c") == [0, 1, 1, 2, 0, 1, 1, 2, 0]


def test_normal_class_upper_bound_is_closed(spark):
    df = series(spark, {"p": [1.0, 2.0, 3.0]}).withColumn("c", scalars.normal_class("p", 2.0, 3.0))
    assert values(df, "c") == [0, 1, 2]


def test_direction_texts_and_numbers(spark):
    rows = [("long", -1), ("Neutral", 0), ("SHORT", 1), ("other", 0), ("-3", -1), ("2.5", 1), (None, 0)]
    df = spark.createDataFrame(rows, "t string, want int").withColumn("got", scalars.direction_code("t"))
    assert all(r.got == r.want for r in df.collect())


def test_unplanned_text_is_not_planned(spark):
    rows = [("Planned maintenance", False), ("Unplanned outage", True), ("unplanned", True), ("Failure", True), (None, True)]
    df = spark.createDataFrame(rows, "t string, want boolean").withColumn("got", scalars.is_unplanned("t"))
    assert all(r.got == r.want for r in df.collect())


def test_dst_instants(spark):
    ts = lambda x: F.lit(x).cast("timestamp")
    r = one(
        spark,
        gap=cal.to_instant(ts("2025-03-30 02:30:00")), first=cal.to_instant(ts("2025-10-26 02:30:00")),
        second=cal.second_occurrence(ts("2025-10-26 02:30:00")), plain=cal.second_occurrence(ts("2025-07-01 12:00:00")),
    )
    want = [datetime(2025, 3, 30, 1), datetime(2025, 10, 26, 0, 30), datetime(2025, 10, 26, 1, 30), datetime(2025, 7, 1, 10)]
    got = [r.gap, r.first, r.second, r.plain]
    assert [g.astimezone(UTC).replace(tzinfo=None) for g in got] == want


def test_local_days_have_92_to_100_slots(spark):
    df = spark.range(0, 96 * 365).select(
        F.lit("A").alias("zone"), F.timestamp_seconds(F.lit(1735686000) + F.col("id") * 900).alias("ts")
    )
    counts = {
        d: projections.local_days(df, d, d).count() for d in ("2025-03-30", "2025-10-26", "2025-06-01")
    }
    assert counts == {"2025-03-30": 92, "2025-10-26": 100, "2025-06-01": 96}


def test_easter_and_holidays(spark):
    years = [(1999, "1999-04-04"), (2000, "2000-04-23"), (2024, "2024-03-31"), (2025, "2025-04-20"), (2038, "2038-04-25")]
    df = spark.createDataFrame(years, "y int, want string").withColumn("got", cal.easter_sunday(F.col("y")).cast("string"))
    assert all(r.got == r.want for r in df.collect())
    days = {
        "2025-01-01": 1, "2025-04-18": 1, "2025-04-21": 1, "2025-05-29": 1, "2025-06-06": 1, "2025-06-20": 1,
        "2025-06-21": 1, "2025-11-01": 1, "2025-12-24": 1, "2025-12-27": 0, "2004-05-31": 1, "2005-05-16": 0,
    }
    df = spark.createDataFrame(list(days.items()), "d string, want int").withColumn(
        "got", cal.is_holiday(F.col("d").cast("date")).cast("int")
    )
    assert {r.d: r.got for r in df.collect()} == days


def test_interval_edges(spark):
    """Off-grid start goes to the next slot, the end is exclusive, empty intervals count nothing."""
    rows = [
        ("A", "2025-01-01 00:05:00", "2025-01-01 01:00:00", 10.0), ("A", "2025-01-01 00:45:00", "2025-01-01 01:20:00", 5.0),
        ("A", "2025-01-01 01:00:00", "2025-01-01 01:00:00", 99.0), ("A", "2024-12-31 00:00:00", "2025-01-01 00:10:00", 0.1),
        ("A", "2025-01-01 01:30:00", "2030-01-01 00:00:00", 0.2),
    ]
    iv = spark.createDataFrame(rows, "zone string, s string, e string, mw double").withColumns(
        {"s": F.col("s").cast("timestamp"), "e": F.col("e").cast("timestamp")}
    )
    out = grid.expand_intervals(iv, QUARTER, "mw", "s", "e", "2025-01-01 00:00:00", "2025-01-01 02:00:00", {"x": F.lit(True)})
    assert close(values(out, "x"), [0.1, 10, 10, 15, 5, 5, 0.2, 0.2, 0.2])


def test_net_and_row_sum(spark):
    rows = [(1.0, None), (None, 2.0), (None, None), (5.0, 3.0)]
    df = spark.createDataFrame(rows, "e double, i double")
    got = df.select(scalars.net_of("e", "i").alias("n"), scalars.row_sum(["e", "i"]).alias("s")).collect()
    assert [(r.n, r.s) for r in got] == [(1.0, 1.0), (-2.0, 2.0), (None, 0.0), (2.0, 8.0)]


def _runs(spark):
    rows = [
        # run at 00:00 covers 0-3, at 01:00 covers 5-6 only, at 02:30 covers 2-8 (made after slots 2..9)
        *[("A", at(k, 60), at(0, 60), float(k)) for k in range(4)],
        *[("A", at(k, 60), at(1, 60), 100.0 + k) for k in (5, 6)],
        *[("A", at(k, 60), at(10, 15), 200.0 + k) for k in range(2, 9)],
    ]
    return spark.createDataFrame(rows, "zone string, ts timestamp, generated_at timestamp, p50 double")


def test_asof_run_and_row_differ(spark):
    actual = series(spark, {"y": [float(k) for k in range(8)]}, minutes=60)
    run = joins.asof_run(actual, _runs(spark))
    row = joins.asof_row(actual, _runs(spark), ["p50"])
    assert values(run, "p50") == [0.0, None, None, 203.0, 204.0, 205.0, 206.0, 207.0]
    assert values(row, "p50") == [0.0, 1.0, 2.0, 203.0, 204.0, 205.0, 206.0, 207.0]
    assert row.where("generated_at > ts").isEmpty()


def test_latest_before_carries_over_blocks(spark):
    left = series(spark, {"x": [1.0] * 500}, minutes=60)
    right = spark.createDataFrame([("A", at(3, 60)), ("A", at(250, 60))], "zone string, g timestamp")
    out = joins.latest_before(left, right, ["zone"], "ts", "g", "g", rows=3)
    got = values(out, "g")
    assert got[:3] == [None] * 3 and len(set(got[3:250])) == 1 and len(set(got[250:])) == 1


def test_nearest_prefers_the_earlier_on_a_tie(spark):
    left = series(spark, {"x": [0.0] * 9}, minutes=60)
    right = spark.createDataFrame([("A", at(2, 60), 1.0), ("A", at(6, 60), 2.0)], "zone string, ts timestamp, v double")
    for block in (2, 10**6):
        out = joins.nearest(left, right, ["v"], rows=block)
        assert values(out, "v") == [1.0] * 5 + [2.0] * 4


def test_mode_ties_and_empty(spark):
    rows = [("a", 2), ("a", 1), ("a", 1), ("a", 2), ("b", None), ("c", 5), ("c", None), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    assert {r.k: r.v for r in aggregates.mode_by(df, ["k"], "v").collect()} == {"a": 1, "b": None, "c": 5}


def test_dedup_first_and_last(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 2, "b"), (1, 2, "x")], "k int, o int, v string")
    pick = lambda keep: {r.k: r.v for r in grid.dedup(df, ["k"], ["o"], keep).collect()}
    assert pick("first") == {1: "a", 2: "b"} and pick("last") == {1: "c", 2: "b"}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 333, 999, 1000, 1001, 2500, 9000])
def test_exact_percentiles(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.exponential(10, n), 2)
    # A third of the rows hold one value.
    x[: n // 3] = 7.0
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, v double")
    ps = {"p01": 0.01, "p33": 1 / 3, "p50": 0.5, "p95": 0.95, "p0": 0.0, "p1": 1.0}
    got = quantiles.exact_percentiles(df, ["k"], "v", ps).first()
    assert all(math.isclose(got[c], float(np.quantile(x, p)), abs_tol=1e-9) for c, p in ps.items())
    whole = quantiles.exact_percentiles(df, [], "v", ps).first()
    assert whole["p50"] == got["p50"]


def _scores(spark, labels):
    s = [0.1, 0.4, 0.4, 0.8, 0.8, 0.35, 0.9, 0.05, 0.4, 0.6]
    return spark.createDataFrame(list(zip(s, labels)), "s double, y int"), np.array(s), np.array(labels)


def test_auc_with_ties_against_pairs(spark):
    df, s, y = _scores(spark, [0, 0, 1, 1, 0, 1, 1, 0, 0, 1])
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert math.isclose(evaluate.auc(df, "s", "y").first().auc, want)


@pytest.mark.parametrize("label", [0, 1])
def test_single_class_scores(spark, label):
    df, _, _ = _scores(spark, [label] * 10)
    m = evaluate.eval_spike(df, "s", "y", 0.95).first()
    assert (m.auc, m.recall, m.precision, m.f2) == (None, 0.0, 0.0, 0.0)


def test_sweep_is_strict_and_profit_is_not(spark):
    df, s, y = _scores(spark, [0, 0, 1, 1, 0, 1, 1, 0, 0, 1])
    sweep = {r.threshold: r.n_predicted for r in evaluate.threshold_sweep(df, "s", "y").collect()}
    assert sweep == {t: int((s > t).sum()) for t in evaluate.SWEEP_GRID}
    curve = evaluate.profit_curve(df.withColumn("p", F.lit(100.0)), "s", "y", "p", [0.4, 0.8])
    got = {r.threshold: r.profit for r in curve.collect()}
    want = {t: 25.0 * (y[s >= t] == 1).sum() - 3.75 * (y[s >= t] == 0).sum() for t in (0.4, 0.8)}
    assert got == want


def test_threshold_rule(spark):
    def decide(rows, current):
        df = spark.createDataFrame(rows, "threshold double, recall double, precision double, f2 double")
        return evaluate.recommend_threshold(df, current).first()

    good = decide([(0.3, 0.6, 0.4, 0.5), (0.4, 0.5, 0.5, 0.4), (0.5, 0.45, 0.6, 0.35)], 0.4)
    assert good.decision == "no_change" and good.recommended_threshold == 0.4
    weak = decide([(0.2, 0.9, 0.1, 0.6), (0.3, 0.5, 0.2, 0.29), (0.4, 0.2, 0.3, 0.2)], 0.4)
    assert weak.decision == "applied" and weak.recommended_threshold == 0.3 and weak.action == "decrease"


def test_histogram_and_boxes_cover_all_rows(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(101)] + [("b", 5.0)], "k string, v double")
    assert sum(r.n for r in aggregates.histogram(df, "v", 40).collect()) == 102
    h = aggregates.histogram(df, "v", 10, by=["k"], density=True).where("k = 'a'").collect()
    assert math.isclose(sum(r.density for r in h) * 10.0, 1.0)
    flat = spark.createDataFrame([(3.0,)] * 4, "v double")
    assert [r.n for r in aggregates.histogram(flat, "v", 3).orderBy("bin").collect()] == [4, 0, 0]


def test_no_future_leaks_into_features(spark):
    """Changing rows after a time leaves every earlier feature as it was."""
    df = wave_frame(spark, 220, zones=("A",))
    cut = F.lit(at(150)).cast("timestamp")
    changed = df.withColumns(
        {c: F.when(F.col("ts") > cut, F.col(c) * 3 + 7).otherwise(F.col(c)) for c in ("imbl_price", "windspeed_100m", "net_position_mw")}
    )
    keep = lambda d: imbalance_features(d).where(F.col("ts") <= cut).drop("target_price", "target_binary", "target_class")
    assert same_rows(keep(df), keep(changed))
    names = [c for c in feature_list(imbalance_features(df).columns) if c not in ("windspeed_100m",)]
    now = F.lit(at(100)).cast("timestamp")
    # A slot's own price must not enter its features either.
    own = df.withColumn("imbl_price", F.when(F.col("ts") == now, 1e4).otherwise(F.col("imbl_price")))
    row = lambda d: imbalance_features(d).where(F.col("ts") == now).select(*names)
    assert same_rows(row(df), row(own))


def test_spot_features_reach_back_a_day(spark):
    n = 900
    rng = np.random.default_rng(1)
    cols = {c: [float(v) for v in rng.normal(10, 3, n)] for c in (
        "price_eur_mwh", "windspeed_100m", "temperature", "cloudcover", "solar_radiation", "wind_gen_mw", "load_mw")}
    df = series(spark, cols, minutes=60)
    f = spot_features(df)
    got = f.orderBy("ts").select("price_roll_720h_mean", "price_roll_168h_std", "price_ewa").collect()
    p = pd.Series(cols["price_eur_mwh"]).shift(24)
    assert math.isclose(got[-1][0], p.rolling(720).mean().iloc[-1]) and got[742][0] is None and got[743][0] is not None
    assert math.isclose(got[-1][1], p.rolling(168).std().iloc[-1])
    assert "fcst_wind_surprise" in f.columns and "smhi_wind_surprise" in f.columns


def test_feature_lists_by_mode(spark):
    cols = imbalance_features(wave_frame(spark, 30, zones=("A",))).columns
    base, spike, regime = (feature_list(cols, m) for m in ("regression", "spike", "regime"))
    assert base == regime and "price_zscore_1h" in spike and "price_zscore_1h" not in base
    assert len(set(spike)) == len(spike)
    with pytest.raises(ValueError):
        feature_list(cols, "other")


def test_outputs_hold_no_nan(spark):
    f = imbalance_features(wave_frame(spark, 120, zones=("A",)))
    doubles = [c for c, t in f.dtypes if t == "double"]
    row = f.agg(*[F.count_if(F.isnan(c)).alias(c) for c in doubles]).first()
    assert not any(row.asDict().values())


def test_presence_and_schema_helpers(spark):
    df = series(spark, {"a": [1.0, None], "b": [1.0, 2.0]}).withColumn("c", F.lit(None).cast("double"))
    assert projections.drop_all_null(df).columns == ["zone", "ts", "a", "b"]
    assert projections.prefer(df, "z", "b") == "b"
    assert projections.complete(df, ["a", "missing"]).count() == 1
    assert T0 == datetime(2025, 1, 1)
    assert values(grid.fill_median(series(spark, {"a": [1.0, None, 3.0]}), ["a"]), "a") == [1.0, 2.0, 3.0]


def test_autocorrelation_drops_missing_first(spark):
    x = [1.0, None, 4.0, 2.0, 8.0, None, 5.0, 7.0]
    got = aggregates.acf(series(spark, {"x": x}), QUARTER, "x", 2).orderBy("lag").collect()
    v = np.array([a for a in x if a is not None])
    d = v - v.mean()
    want = [np.mean(d[k:] * d[:-k]) / v.var() for k in (1, 2)]
    assert close([r.acf for r in got], want)
    assert math.isclose(got[0].band, 1.96 / math.sqrt(6))
