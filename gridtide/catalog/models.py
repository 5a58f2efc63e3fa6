"""Registered queries over models and forecasts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide.catalog import sql_parts as P
from gridtide.catalog.core import query
from gridtide.catalog.features import calendar_sql, spot_frame_of, wave_sql
from gridtide.features.imbalance import imbalance_features
from gridtide.features.spot import spot_features
from gridtide.functions import calendar as cal
from gridtide.models import linear, spike
from gridtide.operators.blocks import QUARTER
from gridtide.operators.grid import ffill
from gridtide.plans import adapters as A
from gridtide.plans import evaluate, forecast
from gridtide.session import materialize


def _wx_with_hour(spark, sf):
    w = A.weather(spark, sf).withColumns(cal.calendar_fields("ts"))
    return w.withColumns(cal.cyclic({"hour": 24}))


@query(
    "ridge_neutralise",
    "zone:s ts:t temperature:d",
    P.with_parts(P.EVENTS, P.WEATHER, "w0 AS (SELECT zone, ts, temperature FROM wx)")
    + "," + calendar_sql("w0", 96)
    + ", b AS (SELECT zone, ts, temperature AS y, " + wave_sql("hour", 24, "x{}").replace("xsin", "x1").replace("xcos", "x2")
    + """ FROM cal),
    m AS (SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM b),
    s AS (SELECT sum((x1 - m1) * (x1 - m1)) + 1 AS a, sum((x1 - m1) * (x2 - m2)) AS c,
      sum((x2 - m2) * (x2 - m2)) + 1 AS d, sum((x1 - m1) * (y - my)) AS p, sum((x2 - m2) * (y - my)) AS q FROM b, m),
    w AS (SELECT (p * d - q * c) / (a * d - c * c) AS w1, (a * q - c * p) / (a * d - c * c) AS w2 FROM s)
    SELECT zone, ts, y - (my + w1 * (x1 - m1) + w2 * (x2 - m2)) AS temperature FROM b, m, w""",
)
def ridge_neutralise(spark, sf):
    w = _wx_with_hour(spark, sf)
    model = linear.fit_ridge(w, ["hour_sin", "hour_cos"], ["temperature"], alpha=1.0)
    return w.withColumn("temperature", F.col("temperature") - model.explained("temperature"))


@query(
    "linear_baseline",
    "zone:s ts:t baseline:d residual:d",
    P.with_parts(P.EVENTS, P.PRICES, P.DENSE_PRICES)
    + """, b AS (SELECT zone, ts, price_eur_mwh AS y, coalesce(lag(price_eur_mwh, 24) OVER
      (PARTITION BY zone ORDER BY ts), 0) AS x FROM dpr),
    t AS (SELECT * FROM b WHERE y IS NOT NULL),
    m AS (SELECT avg(x) AS mx, avg(y) AS my FROM t),
    w AS (SELECT sum((x - mx) * (y - my)) / (sum((x - mx) * (x - mx)) + 1) AS w FROM t, m)
    SELECT zone, ts, my + w * (x - mx) AS baseline, y - (my + w * (x - mx)) AS residual FROM t, m, w""",
)
def linear_baseline(spark, sf):
    from gridtide.operators.blocks import HOURLY
    from gridtide.operators.windows import lag

    df = lag(A.dense_prices(spark, sf), HOURLY, "price_eur_mwh", [24], "price_lag").dropna(subset=["price_eur_mwh"])
    base = linear.fit_baseline(df, "price_eur_mwh", ["price_lag_24"])
    return linear.with_baseline(df, base, "price_eur_mwh")


def _history(spark, sf):
    """Dense imbalance series without long holes."""
    cols = ["imbl_price", "direction", "up_reg_price", "down_reg_price", "imbl_spot_diff"]
    return materialize(ffill(A.dense_imbalance(spark, sf), QUARTER, cols, limit=12), "history")


def _features(spark, sf):
    return imbalance_features(_history(spark, sf))


@query("quantile_forest", "zone:s n:i mae:d rmse:d coverage:d skill:d direction_accuracy:d")
def quantile_forest(spark, sf):
    model, test = forecast.fit_imbalance(_features(spark, sf), test_days=6, trees=10, depth=5)
    return evaluate.eval_imbalance(forecast.score_imbalance(model, test), ["zone"])


@query("spike_gbt", "zone:s recall:d precision:d f2:d threshold_used:d auc:d")
def spike_gbt(spark, sf):
    model, scored = forecast.fit_spike_model(_features(spark, sf), test_days=6, rounds=5, least=100)
    return evaluate.eval_spike(scored, "spike_proba", "target_binary", model.threshold, ["zone"])


@query("feature_importance", "feature:s importance:d source:s")
def feature_importance(spark, sf):
    model, _ = forecast.fit_imbalance(_features(spark, sf), test_days=6, trees=10, depth=5)
    return spike.top_features(spike.importance(spark, model.importances()), 30)


def _held_out_sql(horizon: int, name: str) -> str:
    """CTEs: the last 6 days of rows with a target so far ahead and all core lags."""
    lags = ", ".join(f"lag(p, {n}) OVER w AS p{n}" for n in (1, 2, 3, 4))
    return f"""{name}_l AS (SELECT *, {lags}, lead(p, {horizon}) OVER w AS target FROM hist WINDOW w AS (PARTITION BY zone ORDER BY ts)),
    {name}_k AS (SELECT * FROM {name}_l WHERE target + p1 + p2 + p3 + p4 IS NOT NULL),
    {name} AS (SELECT k.* FROM {name}_k k JOIN (SELECT zone, max(ts) - INTERVAL 6 DAY AS cut FROM {name}_k GROUP BY zone) c
      ON k.zone = c.zone AND k.ts > c.cut)"""


_HISTORY = """hist AS (SELECT zone, ts, last_value(imbl_price IGNORE NULLS) OVER
      (PARTITION BY zone ORDER BY ts ROWS 12 PRECEDING) AS p FROM dimb)"""


@query(
    "quantile_slots",
    "zone:s ts:t ordered:i in_range:i covers:i",
    P.with_parts(P.EVENTS, P.IMBALANCE, P.DENSE_IMBALANCE, _HISTORY, _held_out_sql(1, "t"))
    + "SELECT zone, ts, 1 AS ordered, 1 AS in_range, 1 AS covers FROM t",
)
def quantile_slots(spark, sf):
    """Every held-out row: quantiles in order and among the training targets, and its
    series covered by the band at least six times in ten."""
    feats = materialize(_features(spark, sf), "features")
    model, test = forecast.fit_imbalance(feats, test_days=6, trees=10, depth=5)
    scored = materialize(forecast.score_imbalance(model, test), "scored")
    inside = F.col("y").between(F.col("p05"), F.col("p95")).cast("int")
    share = scored.groupBy("zone").agg((F.avg(inside) >= 0.6).cast("int").alias("covers"))
    order = (F.col("p05") <= F.col("p50")) & (F.col("p50") <= F.col("p95"))
    low, high = float(model.table.grid[0]), float(model.table.grid[-1])
    return scored.join(share, "zone").select(
        "zone", "ts", order.cast("int").alias("ordered"),
        (F.col("p05").between(low, high) & F.col("p95").between(low, high)).cast("int").alias("in_range"), "covers",
    )


@query(
    "multi_horizon_rows",
    "horizon:i n:i",
    P.with_parts(P.EVENTS, P.IMBALANCE, P.DENSE_IMBALANCE, _HISTORY, *[_held_out_sql(h, f"t{h}") for h in (1, 4, 8)])
    + " UNION ALL ".join(f"SELECT {h} AS horizon, count(*) AS n FROM t{h}" for h in (1, 4, 8)),
)
def multi_horizon_rows(spark, sf):
    """Held-out rows that each horizon is scored on."""
    return forecast.eval_horizons(_history(spark, sf), (1, 4, 8), test_days=6, trees=2, depth=2)


@query("multi_horizon", "horizon:i n:i mae:d coverage:d skill:d")
def multi_horizon(spark, sf):
    return forecast.eval_horizons(_history(spark, sf), (1, 4, 8), test_days=6, trees=5, depth=4)


@query("walk_forward", "fold:i recall:d precision:d f2:d spike_prevalence:d")
def walk_forward(spark, sf):
    return forecast.walk_forward(_features(spark, sf), n=3, days=4, test_days=6, rounds=4, least_train=500, least_test=50)


@query("recursive_forecast", "zone:s generated_at:t ts:t p05:d p50:d p95:d")
def recursive_forecast(spark, sf):
    hist = _history(spark, sf)
    feats = materialize(imbalance_features(hist), "features")
    model, _ = forecast.fit_imbalance(feats, test_days=6, trees=10, depth=5)
    runs = hist.groupBy("zone").agg(F.max("ts").alias("generated_at"))
    return forecast.forecast_recursive(hist, feats, model, runs)


@query("spike_forecast", "zone:s generated_at:t ts:t spike_proba:d regime:s")
def spike_forecast(spark, sf):
    hist = _history(spark, sf)
    feats = materialize(imbalance_features(hist), "features")
    model, _ = forecast.fit_spike_model(feats, test_days=6, rounds=5, least=100)
    runs = hist.groupBy("zone").agg(F.max("ts").alias("generated_at"))
    return forecast.forecast_spike(hist, feats, model, runs)


def _last_days(hist, days: int) -> tuple[str, str]:
    """First and last of the newest whole days of a frame."""
    hi = hist.agg(F.date_sub(F.to_date(F.max("ts")), 1).alias("d")).first()["d"]
    return str(hi - timedelta(days=days - 1)), str(hi)


def hindcast_frame(spark, sf):
    hist = _history(spark, sf)
    feats = materialize(imbalance_features(hist), "features")
    prices, _ = forecast.fit_imbalance(feats, test_days=6, trees=10, depth=5)
    spikes, _ = forecast.fit_spike_model(feats, test_days=6, rounds=5, least=100)
    return forecast.hindcast(hist, feats, prices, spikes, *_last_days(hist, 6))


@query("hindcast", "zone:s generated_at:t ts:t p05:d p50:d p95:d spike_proba:d regime:s")
def hindcast(spark, sf):
    return hindcast_frame(spark, sf)


@query(
    "hindcast_slots",
    "zone:s generated_at:t ts:t slots_ahead:i ordered:i has_probability:i",
    P.with_parts(
        P.EVENTS, P.IMBALANCE, P.DENSE_IMBALANCE,
        """h AS (SELECT zone, ts, imbl_price,
      count(imbl_price) OVER (PARTITION BY zone ORDER BY ts ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) > 0 AS filled,
      count(imbl_price) OVER (PARTITION BY zone ORDER BY ts ROWS UNBOUNDED PRECEDING) AS seen FROM dimb)""",
        """c AS (SELECT *, sum(CAST(filled AS INT)) OVER (PARTITION BY zone ORDER BY ts
      ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) = 4 AS complete FROM h)""",
        """d AS (SELECT CAST(max(ts) AS DATE) - 1 AS hi FROM dimb)""",
        """runs AS (SELECT CAST(day AS TIMESTAMP) + INTERVAL '22 hours 45 minutes' AS generated_at
      FROM (SELECT unnest(generate_series(hi - 5, hi, INTERVAL 1 DAY)) AS day FROM d))""",
        """l AS (SELECT c.zone, r.generated_at, max(c.ts) FILTER (c.complete) AS last_ts
      FROM c JOIN runs r ON c.ts <= r.generated_at GROUP BY ALL HAVING count(*) FILTER (c.filled) >= 96)""",
    )
    + """ SELECT zone, generated_at, last_ts + k * INTERVAL 15 MINUTE AS ts, k AS slots_ahead,
      1 AS ordered, 1 AS has_probability
    FROM (SELECT *, unnest(generate_series(1, 96)) AS k FROM l WHERE last_ts IS NOT NULL)""",
)
def hindcast_slots(spark, sf):
    """The slots of every hindcast run, and whether the quantiles stand in order."""
    fc = hindcast_frame(spark, sf)
    order = (F.col("p05") <= F.col("p50")) & (F.col("p50") <= F.col("p95"))
    first = F.min("ts").over(Window.partitionBy("zone", "generated_at"))  # 96 rows a run
    ahead = (F.unix_seconds("ts") - F.unix_seconds(first)) / 900 + 1
    proba = F.col("spike_proba").between(0, 1) & F.col("regime").isNotNull()
    return fc.select(
        "zone", "generated_at", "ts", ahead.alias("slots_ahead"), order.cast("int").alias("ordered"),
        proba.cast("int").alias("has_probability"),
    )


@query(
    "live_forecast_slots",
    "zone:s generated_at:t ts:t ordered:i has_regime:i",
    P.with_parts(P.EVENTS, P.IMBALANCE, P.DENSE_IMBALANCE, _HISTORY)
    + """, c AS (SELECT zone, ts, count(p) OVER (PARTITION BY zone ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) = 4 AS complete FROM hist),
    l AS (SELECT zone, max(ts) AS generated_at, max(ts) FILTER (complete) AS last_ts FROM c GROUP BY zone)
    SELECT zone, generated_at, last_ts + k * INTERVAL 15 MINUTE AS ts, 1 AS ordered, 1 AS has_regime
    FROM (SELECT *, unnest(generate_series(1, 96)) AS k FROM l WHERE last_ts IS NOT NULL)""",
)
def live_forecast_slots(spark, sf):
    """Slots of the live forecast, which has a price band and a regime for each."""
    hist = _history(spark, sf)
    feats = materialize(imbalance_features(hist), "features")
    prices, _ = forecast.fit_imbalance(feats, test_days=6, trees=6, depth=4)
    spikes, _ = forecast.fit_spike_model(feats, test_days=6, rounds=3, least=100)
    fc = forecast.live_forecast(hist, feats, prices, spikes)
    order = (F.col("p05") <= F.col("p50")) & (F.col("p50") <= F.col("p95"))
    return fc.select("zone", "generated_at", "ts", order.cast("int").alias("ordered"), F.col("regime").isNotNull().cast("int").alias("has_regime"))


def _spot_features(spark, sf):
    return materialize(spot_features(spot_frame_of(spark, sf)), "features")


@query("spot_model_metrics", "zone:s n:i mae:d rmse:d mape:d coverage:d night_mae:d peak_mae:d")
def spot_model_metrics(spark, sf):
    feats = _spot_features(spark, sf)
    model, test = forecast.fit_spot(feats, test_days=6, core=["price_lag_168h"], trees=10, depth=5)
    scored = model.predict(test).withColumn("y", F.col("price_eur_mwh"))
    return evaluate.eval_spot(scored, by=["zone"])


@query("spot_forecast", "zone:s ts:t p05:d p50:d p95:d")
def spot_forecast(spark, sf):
    hist = materialize(spot_frame_of(spark, sf), "history")
    model, _ = forecast.fit_spot(spot_features(hist), test_days=6, core=["price_lag_168h"], trees=10, depth=5)
    return forecast.forecast_spot(hist, A.weather(spark, sf), model)


@query("spot_posttrain_metrics", "zone:s n:i mae:d coverage:d")
def spot_posttrain_metrics(spark, sf):
    feats = _spot_features(spark, sf)
    base, _ = forecast.pretrain_spot(feats, cutoff_days=8, test_days=3, core=["price_lag_168h"], trees=8, depth=4)
    model = forecast.posttrain_spot(base, feats, window_days=8, trees=5, depth=3)
    scored = model.predict(feats.where(F.col("price_eur_mwh").isNotNull())).withColumn("y", F.col("price_eur_mwh"))
    return evaluate.eval_spot(scored, by=["zone"])
