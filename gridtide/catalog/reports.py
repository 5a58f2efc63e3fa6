"""Registered queries over aggregates, evaluation and read-side tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.catalog import sql_parts as P
from gridtide.catalog.align import BY, IMB, PR
from gridtide.catalog.core import query
from gridtide.catalog.features import MASTER, MASTER_FOUR, WF, four_sources, master_of
from gridtide.features.imbalance import imbalance_features
from gridtide.functions.scalars import is_spike
from gridtide.operators import aggregates, quantiles
from gridtide.operators.blocks import HOURLY
from gridtide.plans import adapters as A
from gridtide.plans import evaluate, master, serve

SC = P.with_parts(P.EVENTS, P.PRICES, P.DENSE_PRICES, P.RUNS, P.SCORED)
FCQ = P.with_parts(P.EVENTS, P.PRICES, P.DENSE_PRICES, P.RUNS)
NOW_TEXT = "2024-01-24 12:00:00"
NOW_SQL = f"TIMESTAMP '{NOW_TEXT}'"


def now():
    return F.lit(NOW_TEXT).cast("timestamp")


# --- aggregates ----------------------------------------------------------------


@query(
    "price_stats",
    "zone:s mean:d min:d max:d std:d n:i",
    PR + """SELECT zone, avg(price_eur_mwh) AS mean, min(price_eur_mwh) AS min, max(price_eur_mwh) AS max,
    stddev_samp(price_eur_mwh) AS std, count(price_eur_mwh) AS n FROM pr GROUP BY zone""",
)
def price_stats(spark, sf):
    return aggregates.stats(A.prices(spark, sf), "price_eur_mwh", ["zone"])


@query(
    "price_distribution",
    "zone:s mean:d median:d std:d min:d max:d pct_negative:d pct_above_200:d pct_above_1000:d",
    IMB + """SELECT zone, avg(imbl_price) AS mean, median(imbl_price) AS median, stddev_samp(imbl_price) AS std,
    min(imbl_price) AS min, max(imbl_price) AS max, 100.0 * avg(CAST(imbl_price < 0 AS INT)) AS pct_negative,
    100.0 * avg(CAST(imbl_price > 200 AS INT)) AS pct_above_200,
    100.0 * avg(CAST(imbl_price > 1000 AS INT)) AS pct_above_1000 FROM imb GROUP BY zone""",
)
def price_distribution(spark, sf):
    return aggregates.price_distribution(A.imbalance(spark, sf), "imbl_price", ["zone"])


@query(
    "mode_by_hour",
    "zone:s hour:i event_type:s",
    P.with_parts(P.EVENTS) + """SELECT zone, hour, event_type FROM (SELECT zone, hour(ts) AS hour, event_type,
    count(*) AS n FROM ev GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY zone, hour ORDER BY n DESC, event_type) = 1""",
)
def mode_by_hour(spark, sf):
    e = A.events(spark, sf).withColumn("hour", F.hour("ts"))
    return aggregates.mode_by(e, ["zone", "hour"], "event_type")


@query(
    "direction_split",
    "zone:s n_long:i n_neutral:i n_short:i n:i pct_long:d pct_neutral:d pct_short:d",
    P.with_parts(P.EVENTS, P.IMBALANCE, P.DENSE_IMBALANCE)
    + """, c AS (SELECT zone, count(*) FILTER (WHERE direction < 0) AS n_long,
    count(*) FILTER (WHERE direction = 0) AS n_neutral, count(*) FILTER (WHERE direction > 0) AS n_short,
    count(direction) AS n FROM dimb GROUP BY zone)
    SELECT *, 100.0 * n_long / n AS pct_long, 100.0 * n_neutral / n AS pct_neutral, 100.0 * n_short / n AS pct_short FROM c""",
)
def direction_split(spark, sf):
    return aggregates.direction_split(A.dense_imbalance(spark, sf), "direction", ["zone"])


@query(
    "direction_split_all_rows",
    "n_long:i n_neutral:i n_short:i n:i pct_long:d",
    P.with_parts(P.EVENTS, P.IMBALANCE, P.DENSE_IMBALANCE)
    + """, c AS (SELECT count(*) FILTER (WHERE direction < 0) AS n_long,
    count(*) FILTER (WHERE direction = 0) AS n_neutral, count(*) FILTER (WHERE direction > 0) AS n_short,
    count(*) AS n FROM dimb) SELECT *, 100.0 * n_long / n AS pct_long FROM c""",
)
def direction_split_all_rows(spark, sf):
    return aggregates.direction_split(A.dense_imbalance(spark, sf), "direction", all_rows=True)


@query(
    "spike_class_split",
    "spike_class:i n:i prevalence:d",
    IMB + """, c AS (SELECT CASE WHEN imbl_price > 1000 OR imbl_price < -500 THEN 2
    WHEN imbl_price > 200 OR imbl_price < -100 THEN 1 ELSE 0 END AS spike_class FROM imb)
    SELECT spike_class, count(*) AS n, count(*) / (SELECT count(*) FROM c)::DOUBLE AS prevalence FROM c GROUP BY spike_class""",
)
def spike_class_split(spark, sf):
    return aggregates.class_split(A.imbalance(spark, sf), "imbl_price")


@query(
    "mae_by_hour", "hour:i mae:d",
    SC + f"SELECT hour({P.local('ts')}) AS hour, avg(abs(p50 - y)) AS mae FROM sc GROUP BY ALL",
)
def mae_by_hour(spark, sf):
    return aggregates.mae_by_hour(A.scored(spark, sf), "y", "p50")


@query(
    "daily_mae", "day:s mae:d",
    SC + f"SELECT strftime({P.local('ts')}, '%Y-%m-%d') AS day, avg(abs(p50 - y)) AS mae FROM sc GROUP BY ALL",
)
def daily_mae(spark, sf):
    return aggregates.daily_mae(A.scored(spark, sf), "y", "p50")


def _median_sql(part: str, expr: str) -> str:
    return (
        P.with_parts(P.EVENTS)
        + f"SELECT {expr.format(P.local('ts'))} AS {part}, median(value) AS median FROM ev GROUP BY ALL"
    )


@query("median_by_hour", "hour:i median:d", _median_sql("hour", "hour({})"))
def median_by_hour(spark, sf):
    return aggregates.median_by(A.events(spark, sf), "value", "hour")


@query("median_by_weekday", "weekday:i median:d", _median_sql("weekday", "isodow({}) - 1"))
def median_by_weekday(spark, sf):
    return aggregates.median_by(A.events(spark, sf), "value", "weekday")


@query(
    "median_month_end", "month_end:s median:d",
    f"""SELECT strftime(last_day({P.local('o_orderdate')}), '%Y-%m-%d') AS month_end,
    median(o_totalprice) AS median FROM orders GROUP BY ALL""",
)
def median_month_end(spark, sf):
    o = A.read(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"), "o_totalprice")
    out = aggregates.median_by(o, "o_totalprice", "month_end")
    return out.withColumn("month_end", F.date_format("month_end", "yyyy-MM-dd"))


@query(
    "spike_rate_by_month", "month:i spike_rate:d",
    IMB + f""", r AS (SELECT month({P.local('ts')}) AS month,
    avg(CASE WHEN imbl_price > 200 OR imbl_price < -100 THEN 1.0 ELSE 0.0 END) AS r FROM imb GROUP BY ALL)
    SELECT m AS month, coalesce(r, 0) AS spike_rate FROM range(1, 13) t(m) LEFT JOIN r ON r.month = m""",
)
def spike_rate_by_month(spark, sf):
    return aggregates.spike_rate_by(A.imbalance(spark, sf), "imbl_price", "month")


@query(
    "spike_rate_by_hour", "hour:i spike_rate:d",
    IMB + f"""SELECT hour({P.local('ts')}) AS hour,
    avg(CASE WHEN imbl_price > 200 OR imbl_price < -100 THEN 1.0 ELSE 0.0 END) AS spike_rate FROM imb GROUP BY ALL""",
)
def spike_rate_by_hour(spark, sf):
    return aggregates.spike_rate_by(A.imbalance(spark, sf), "imbl_price", "hour")


_PS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@query(
    "percentile_table", "p:d value:d",
    f"""SELECT unnest({_PS}) AS p, unnest(q) AS value FROM
    (SELECT quantile_cont(l_extendedprice, {_PS}) AS q FROM lineitem)""",
)
def percentile_table(spark, sf):
    return aggregates.percentiles(A.read(spark, sf, "lineitem"), "l_extendedprice", _PS)


_HIST = """SELECT b AS bin, lo + b * (hi - lo) / {n} AS bin_start, coalesce(c.n, 0) AS n
  FROM (SELECT min(x) AS lo, max(x) AS hi FROM h), range({n}) t(b) LEFT JOIN
  (SELECT least(floor((x - lo) / ((hi - lo) / {n})), {n} - 1) AS bin, count(*) AS n
   FROM h, (SELECT min(x) AS lo, max(x) AS hi FROM h) GROUP BY 1) c ON c.bin = b"""


@query(
    "histogram_40", "bin:i bin_start:d n:i",
    SC + ", h AS (SELECT p50 - y AS x FROM sc) " + _HIST.format(n=40),
)
def histogram_40(spark, sf):
    df = A.scored(spark, sf).withColumn("err", F.col("p50") - F.col("y"))
    return aggregates.histogram(df, "err", 40)


@query(
    "histogram_clipped", "bin:i bin_start:d n:i",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.99) AS b FROM lineitem),
    h AS (SELECT greatest(least(l_extendedprice, b), a) AS x FROM lineitem, q) """ + _HIST.format(n=80),
)
def histogram_clipped(spark, sf):
    return aggregates.histogram(A.read(spark, sf, "lineitem"), "l_extendedprice", 80, clip_at=(0.01, 0.99))


@query(
    "histogram_density_by_class", "y_spike:i bin:i bin_start:d n:i density:d",
    SC + """, s AS (SELECT min(spike_proba) AS lo, max(spike_proba) AS hi FROM sc),
    g AS (SELECT y_spike, b FROM (SELECT DISTINCT y_spike FROM sc), range(50) t(b)),
    c AS (SELECT y_spike, least(floor((spike_proba - lo) / ((hi - lo) / 50)), 49) AS bin, count(*) AS n
      FROM sc, s GROUP BY ALL),
    a AS (SELECT y_spike, count(*) AS total FROM sc GROUP BY ALL)
    SELECT g.y_spike, b AS bin, lo + b * (hi - lo) / 50 AS bin_start, coalesce(n, 0) AS n,
      coalesce(n, 0) / (total * (hi - lo) / 50) AS density
    FROM g JOIN a USING (y_spike) CROSS JOIN s LEFT JOIN c ON c.y_spike = g.y_spike AND c.bin = b""",
)
def histogram_density_by_class(spark, sf):
    return aggregates.histogram(A.scored(spark, sf), "spike_proba", 50, by=["y_spike"], density=True)


@query(
    "price_ecdf", "price:d n:i share_first:d share_last:d",
    """WITH c AS (SELECT l_quantity AS price, count(*) AS n FROM lineitem GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (ORDER BY price) AS upto, (SELECT count(*) FROM lineitem) AS total FROM c)
    SELECT price, n, (upto - n) / (total - 1)::DOUBLE AS share_first, (upto - 1) / (total - 1)::DOUBLE AS share_last FROM r""",
)
def price_ecdf(spark, sf):
    li = A.read(spark, sf, "lineitem").select(F.col("l_quantity").alias("price"))
    return quantiles.ecdf(li, "price")


@query(
    "box_stats", "o_orderpriority:s q1:d median:d q3:d whisker_low:d whisker_high:d n:i",
    """WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS median,
      quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY ALL)
    SELECT o_orderpriority, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
      min(o_totalprice) FILTER (WHERE o_totalprice >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
      max(o_totalprice) FILTER (WHERE o_totalprice <= q3 + 1.5 * (q3 - q1)) AS whisker_high, count(*) AS n
    FROM orders JOIN q USING (o_orderpriority) GROUP BY o_orderpriority""",
)
def box_stats(spark, sf):
    return aggregates.box_stats(A.read(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"])


@query(
    "binned_mean", "bin:i center:d mean:d n:i",
    P.with_parts(P.EVENTS) + """, s AS (SELECT min(k) AS lo, max(k) AS hi, (max(k) - min(k)) / 20 AS w FROM ev),
    b AS (SELECT greatest(ceil((k - lo) / w) - 1, 0) AS bin, value FROM ev, s)
    SELECT bin, ((CASE WHEN bin = 0 THEN lo - 0.001 * (hi - lo) ELSE lo + bin * w END) + lo + (bin + 1) * w) / 2 AS center,
    avg(value) AS mean, count(value) AS n FROM b, s GROUP BY bin, lo, hi, w""",
)
def binned_mean(spark, sf):
    return aggregates.binned_mean(A.events(spark, sf), "k", "value", 20)


_ACF_TERMS = " UNION ALL ".join(
    f"SELECT zone, {k} AS lag, avg(d * d{k}) AS c FROM l GROUP BY zone" for k in range(1, 49)
)


@query(
    "autocorrelation", "zone:s lag:i acf:d band:d",
    PR + """, m AS (SELECT zone, avg(price_eur_mwh) AS m, var_pop(price_eur_mwh) AS v, count(*) AS n FROM pr GROUP BY zone),
    d AS (SELECT pr.zone, ts, price_eur_mwh - m AS d FROM pr JOIN m USING (zone)),
    l AS (SELECT zone, d, """ + ", ".join(f"lag(d, {k}) OVER w AS d{k}" for k in range(1, 49))
    + f""" FROM d WINDOW w AS ({BY})), t AS ({_ACF_TERMS})
    SELECT t.zone, lag, c / v AS acf, 1.96 / sqrt(n) AS band FROM t JOIN m USING (zone)""",
)
def autocorrelation(spark, sf):
    return aggregates.acf(A.prices(spark, sf), HOURLY, "price_eur_mwh", 48)


def _groups_sql(have: set[str]) -> str:
    def one(g: str, cs: list[str]) -> str:
        own = [c for c in cs if c in have]
        share, most = "NULL", "0"
        if own:
            share = "(" + " + ".join(f"avg(CAST({c} IS NULL AS INT))" for c in own) + f") / {len(own)}"
            most = " + ".join(f"CAST(avg(CAST({c} IS NULL AS INT)) > 0.5 AS INT)" for c in own)
        return (
            f"SELECT '{g}' AS source, {len(cs)} AS columns, {len(own)} AS present, {share} AS null_share, "
            f"{most} AS mostly_null, count(*) AS rows FROM mf"
        )

    return " UNION ALL ".join(one(g, cs) for g, cs in serve.SOURCE_GROUPS.items())


_FOUR = {"imbl_price", "direction", "imbl_spot_diff", "temperature", "windspeed_100m", "cloudcover", "spot_price", "net_position_mw", *WF}


@query("null_report", "source:s columns:i present:i null_share:d mostly_null:i rows:i", MASTER_FOUR + _groups_sql(_FOUR))
def null_report(spark, sf):
    return serve.source_coverage(master.master_frame(A.imbalance(spark, sf), four_sources(spark, sf)))


@query(
    "source_coverage", "source:s columns:i present:i null_share:d mostly_null:i rows:i",
    MASTER + _groups_sql({c for cs in serve.SOURCE_GROUPS.values() for c in cs}),
)
def source_coverage(spark, sf):
    """The same over all sources."""
    return serve.source_coverage(master_of(spark, sf))


@query(
    "peak_price", "zone:s peak:d peak_ts:t",
    P.with_parts(P.EVENTS) + """SELECT zone, max(value) AS peak, arg_max(ts, (value, -epoch_us(ts))) AS peak_ts FROM ev GROUP BY zone""",
)
def peak_price(spark, sf):
    return aggregates.arg_max(A.events(spark, sf), "value", by=["zone"])


@query(
    "describe_columns", "name:s n:i mean:d std:d min:d p25:d p50:d p75:d max:d",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS name, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
        quantile_cont({c}, 0.25) AS p25, median({c}) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def describe_columns(spark, sf):
    return aggregates.describe(A.read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(
    "first_run_date", "first_date:s",
    FCQ + f"SELECT strftime(min(CAST({P.local('generated_at')} AS DATE)), '%Y-%m-%d') AS first_date FROM fc",
)
def first_run_date(spark, sf):
    out = aggregates.first_run_date(A.forecast_runs(spark, sf))
    return out.select(F.date_format("first_date", "yyyy-MM-dd").alias("first_date"))


@query(
    "forecast_card", "zone:s mean_p50:d max_p50:d max_hour:i overnight_min:d mean_half_width:d",
    FCQ + f""", l AS (SELECT *, hour({P.local('ts')}) AS h FROM fc
      QUALIFY generated_at = max(generated_at) OVER (PARTITION BY zone))
    SELECT zone, avg(p50) AS mean_p50, max(p50) AS max_p50, arg_max(h, (p50, -epoch_us(ts))) AS max_hour,
      min(p50) FILTER (WHERE h < 6) AS overnight_min, avg((p95 - p05) / 2) AS mean_half_width FROM l GROUP BY zone""",
)
def forecast_card(spark, sf):
    from gridtide.operators.joins import latest_run

    return aggregates.forecast_card(latest_run(A.forecast_runs(spark, sf)), by=["zone"])


@query(
    "count_above_limit", "zone:s n_above:i",
    P.with_parts(P.EVENTS) + "SELECT zone, count(*) FILTER (WHERE value > 200) AS n_above FROM ev GROUP BY zone",
)
def count_above_limit(spark, sf):
    return aggregates.count_above(A.events(spark, sf), "value", 200, ["zone"])


# --- evaluation ------------------------------------------------------------------


@query(
    "spot_metrics",
    "zone:s n:i mae:d rmse:d mape:d coverage:d night_mae:d peak_mae:d n_spikes:i spike_mae:d",
    SC + f""", e AS (SELECT *, abs(p50 - y) AS a, hour({P.local('ts')}) AS h FROM sc)
    SELECT zone, count(y) AS n, avg(a) AS mae, sqrt(avg(a * a)) AS rmse,
      100 * avg(a / abs(y)) FILTER (WHERE abs(y) > 10) AS mape,
      100.0 * avg(CAST(y >= p05 AND y <= p95 AS INT)) AS coverage,
      avg(a) FILTER (WHERE h IN (23,0,1,2,3,4,5)) AS night_mae,
      avg(a) FILTER (WHERE h IN (7,8,9,17,18,19,20)) AS peak_mae,
      count(*) FILTER (WHERE y > 100) AS n_spikes, avg(a) FILTER (WHERE y > 100) AS spike_mae
    FROM e GROUP BY zone""",
)
def spot_metrics(spark, sf):
    return evaluate.eval_spot(A.scored(spark, sf), by=["zone"])


_DIR = """avg(CAST(sign({p} - lag1) = sign(y - lag1) AS INT))
      FILTER (WHERE sign({p} - lag1) <> 0 AND sign(y - lag1) <> 0)"""


@query(
    "imbalance_metrics", "zone:s n:i mae:d rmse:d coverage:d skill:d direction_accuracy:d",
    SC + f"""SELECT zone, count(y) AS n, avg(abs(p50 - y)) AS mae, sqrt(avg((p50 - y) * (p50 - y))) AS rmse,
      100.0 * avg(CAST(y >= p05 AND y <= p95 AS INT)) AS coverage,
      1 - avg(abs(p50 - y)) / avg(abs(y - lag1)) AS skill, {_DIR.format(p='p50')} AS direction_accuracy
    FROM sc GROUP BY zone""",
)
def imbalance_metrics(spark, sf):
    return evaluate.eval_imbalance(A.scored(spark, sf), ["zone"])


@query(
    "baseline_metrics", "baseline:s n:i mae:d rmse:d direction_accuracy:d",
    SC + " UNION ALL ".join(
        f"""SELECT '{n}' AS baseline, count(y) AS n, avg(abs({c} - y)) AS mae, sqrt(avg(({c} - y) * ({c} - y))) AS rmse,
        {_DIR.format(p=c)} AS direction_accuracy FROM sc WHERE {c} IS NOT NULL"""
        for n, c in (("persistence", "lag1"), ("same_hour", "p50"), ("upper", "p95"))
    ),
)
def baseline_metrics(spark, sf):
    preds = {"persistence": "lag1", "same_hour": "p50", "upper": "p95"}
    return evaluate.eval_baselines(A.scored(spark, sf), preds, 100)


@query(
    "imbalance_baselines", "baseline:s n:i mae:d rmse:d direction_accuracy:d",
    MASTER_FOUR + """, l AS (SELECT *, lag(imbl_price, 1) OVER w AS lag1, count(imbl_price) OVER h AS known, avg(imbl_price) OVER h AS hour_mean
      FROM mf WINDOW w AS (PARTITION BY zone ORDER BY ts), h AS (PARTITION BY zone ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
    sc AS (SELECT imbl_price AS y, lag1, CASE WHEN known = 4 THEN hour_mean END AS mean_1h, spot_price FROM l WHERE imbl_price IS NOT NULL) """
    + " UNION ALL ".join(
        f"""SELECT '{n}' AS baseline, count(y) AS n, avg(abs({c} - y)) AS mae, sqrt(avg(({c} - y) * ({c} - y))) AS rmse,
        {_DIR.format(p=c)} AS direction_accuracy FROM sc WHERE {c} IS NOT NULL HAVING count(y) > 0"""
        for n, c in (("persistence", "lag1"), ("mean_1h", "mean_1h"), ("spot_proxy", "spot_price"))
    ),
)
def imbalance_baselines(spark, sf):
    """The last known price, the mean of the last hour and the day-ahead price as forecasts."""
    frame = master.master_frame(A.imbalance(spark, sf), four_sources(spark, sf))
    feats = imbalance_features(frame).where(F.col("imbl_price").isNotNull())
    rows = feats.select(F.col("imbl_price").alias("y"), F.col("imbl_lag_1").alias("lag1"), F.col("imbl_roll_1h_mean").alias("mean_1h"), "spot_price")
    return evaluate.eval_baselines(rows, {"persistence": "lag1", "mean_1h": "mean_1h", "spot_proxy": "spot_price"})


_CURVE = SC + """, c AS (SELECT spike_proba AS s, sum(y_spike) AS pos, sum(1 - y_spike) AS neg FROM sc GROUP BY ALL),
  k AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp,
    sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg FROM c)"""
_PR = _CURVE + """, p AS (SELECT s AS threshold, tp / (tp + fp) AS precision, tp / all_pos AS recall FROM k),
  f AS (SELECT *, 5 * precision * recall / (4 * precision + recall + 1e-9) AS f2 FROM p)"""


@query("pr_curve", "threshold:d precision:d recall:d f2:d", _PR + " SELECT * FROM f")
def pr_curve(spark, sf):
    return evaluate.pr_curve(A.scored(spark, sf), "spike_proba", "y_spike")


@query(
    "best_f2_threshold", "threshold:d f2:d",
    _PR + " SELECT arg_max(threshold, (f2, -threshold)) AS threshold, max(f2) AS f2 FROM f",
)
def best_f2_threshold(spark, sf):
    return evaluate.best_f2(A.scored(spark, sf), "spike_proba", "y_spike")


@query(
    "roc_curve", "threshold:d fpr:d tpr:d",
    _CURVE + " SELECT s AS threshold, fp / all_neg AS fpr, tp / all_pos AS tpr FROM k",
)
def roc_curve(spark, sf):
    return evaluate.roc_curve(A.scored(spark, sf), "spike_proba", "y_spike")


@query(
    "nearest_curve_point", "threshold:d precision:d recall:d",
    _PR + f""" SELECT threshold, precision, recall FROM f
    ORDER BY abs(threshold - {15.0 / 315.0!r}), threshold LIMIT 1""",
)
def nearest_curve_point(spark, sf):
    curve = evaluate.pr_curve(A.scored(spark, sf), "spike_proba", "y_spike")
    return evaluate.nearest_point(curve, evaluate.cost_threshold())


@query(
    "roc_auc_exact", "zone:s auc:d",
    SC + """, r AS (SELECT zone, y_spike, rank() OVER (PARTITION BY zone ORDER BY spike_proba) AS r,
      count(*) OVER (PARTITION BY zone, spike_proba) AS t FROM sc),
    a AS (SELECT zone, sum(r + (t - 1) / 2.0) FILTER (WHERE y_spike = 1) AS s, sum(y_spike) AS p, count(*) AS n
      FROM r GROUP BY zone)
    SELECT zone, (s - p * (p + 1) / 2.0) / (p * (n - p)) AS auc FROM a""",
)
def roc_auc_exact(spark, sf):
    return evaluate.auc(A.scored(spark, sf), "spike_proba", "y_spike", ["zone"])


_GRID_SQL = "[" + ", ".join(repr(t) for t in evaluate.PROFIT_GRID) + "]"


@query(
    "profit_curve", "threshold:d profit:d",
    SC + f""", t AS (SELECT unnest({_GRID_SQL}::DOUBLE[]) AS threshold)
    SELECT threshold, coalesce(sum(CASE WHEN y_spike = 1 THEN least(greatest(y, 0), 5000) * 0.25 ELSE -15 * 0.25 END)
      FILTER (WHERE spike_proba >= threshold), 0) AS profit FROM t, sc GROUP BY threshold""",
)
def profit_curve(spark, sf):
    return evaluate.profit_curve(A.scored(spark, sf), "spike_proba", "y_spike", "y")


@query(
    "profit_threshold", "threshold:d profit:d",
    SC + f""", t AS (SELECT unnest({_GRID_SQL}::DOUBLE[]) AS threshold),
    c AS (SELECT threshold, coalesce(sum(CASE WHEN y_spike = 1 THEN least(greatest(y, 0), 5000) * 0.25 ELSE -15 * 0.25 END)
      FILTER (WHERE spike_proba >= threshold), 0) AS profit FROM t, sc GROUP BY threshold)
    SELECT threshold, profit FROM c ORDER BY round(profit, 6) DESC, threshold LIMIT 1""",
)
def profit_threshold(spark, sf):
    return evaluate.profit_threshold(evaluate.profit_curve(A.scored(spark, sf), "spike_proba", "y_spike", "y"))


_SWEEP = """, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS threshold),
  n AS (SELECT {by} threshold, count(*) FILTER (WHERE spike_proba > threshold) AS hat,
    count(*) FILTER (WHERE spike_proba > threshold AND y_spike = 1) AS tp, sum(y_spike) AS pos
    FROM {src}, t GROUP BY ALL),
  w0 AS (SELECT *, tp / greatest(pos, 1)::DOUBLE AS r, tp / greatest(hat, 1)::DOUBLE AS p FROM n),
  sweep AS (SELECT {by} threshold, round(r, 3) AS recall, round(p, 3) AS precision,
    round(5 * p * r / greatest(4 * p + r, 1e-9), 3) AS f2, hat AS n_predicted FROM w0)"""


@query(
    "threshold_sweep", "threshold:d recall:d precision:d f2:d n_predicted:i",
    SC + _SWEEP.format(by="", src="sc") + " SELECT * FROM sweep",
)
def threshold_sweep(spark, sf):
    return evaluate.threshold_sweep(A.scored(spark, sf), "spike_proba", "y_spike")


@query(
    "best_sweep_threshold", "zone:s best_threshold:d best_f2:d",
    SC + _SWEEP.format(by="zone,", src="sc")
    + " SELECT zone, arg_max(threshold, (f2, -threshold)) AS best_threshold, max(f2) AS best_f2 FROM sweep GROUP BY zone",
)
def best_sweep_threshold(spark, sf):
    sweep = evaluate.threshold_sweep(A.scored(spark, sf), "spike_proba", "y_spike", by=["zone"])
    return evaluate.best_of_sweep(sweep, ["zone"])


_DECIDE = """, g AS (SELECT day, arg_min(f2, (abs(threshold - 0.45), threshold)) AS cf2,
    arg_min(recall, (abs(threshold - 0.45), threshold)) AS cr,
    arg_max(threshold, (f2, -threshold)) FILTER (WHERE abs(threshold - 0.45) <= 0.15 + 1e-9) AS cand,
    max(f2) FILTER (WHERE abs(threshold - 0.45) <= 0.15 + 1e-9) AS candf2 FROM sweep GROUP BY day),
  r AS (SELECT *, CASE WHEN cf2 > 0.3 AND cr > 0.4 THEN 0.45 ELSE cand END AS rec FROM g),
  dec AS (SELECT day, 0.45 AS current_threshold, rec AS recommended_threshold,
    CASE WHEN abs(rec - 0.45) < 0.01 THEN 'no_change' WHEN rec > 0.45 THEN 'increase' ELSE 'decrease' END AS action,
    CASE WHEN abs(rec - 0.45) < 0.01 THEN 'no_change' WHEN candf2 < cf2 - 0.05 THEN 'rejected' ELSE 'applied' END AS decision,
    candf2 AS f2 FROM r)"""
_DAILY = SC + f", sd AS (SELECT *, strftime({P.local('ts')}, '%Y-%m-%d') AS day FROM sc)" + _SWEEP.format(
    by="day,", src="sd"
) + _DECIDE


def _daily_decisions(spark, sf):
    from gridtide.functions.calendar import local_date

    day = F.date_format(local_date("ts"), "yyyy-MM-dd")
    df = A.scored(spark, sf).withColumn("day", day)
    sweep = evaluate.threshold_sweep(df, "spike_proba", "y_spike", by=["day"])
    return evaluate.recommend_threshold(sweep, 0.45, ["day"])


@query(
    "recommend_threshold", "day:s current_threshold:d recommended_threshold:d action:s decision:s f2:d",
    _DAILY + " SELECT * FROM dec",
)
def recommend_threshold(spark, sf):
    return _daily_decisions(spark, sf)


@query(
    "decision_history", "day:s recommended_threshold:d decision:s",
    _DAILY + " SELECT * FROM dec ORDER BY day DESC LIMIT 20",
)
def decision_history(spark, sf):
    log = _daily_decisions(spark, sf).withColumn("ts", F.col("day").cast("timestamp"))
    return serve.decisions(log, 20)


@query(
    "confusion", "y:i yhat:i n:i row_share:d",
    SC + """, c AS (SELECT y_spike AS y, CAST(spike_proba >= 0.3 AS INT) AS yhat, count(*) AS n FROM sc GROUP BY ALL)
    SELECT *, n / sum(n) OVER (PARTITION BY y) AS row_share FROM c""",
)
def confusion(spark, sf):
    return evaluate.confusion(A.scored(spark, sf), "spike_proba", "y_spike", 0.3)


@query(
    "threshold_table", "name:s tp:i fp:i fn:i recall:d precision:d f2:d",
    SC + f""", t AS (SELECT * FROM (VALUES ('default', 0.5), ('cost', {15.0 / 315.0!r}), ('third', 0.3)) v(name, t)),
    c AS (SELECT name, count(*) FILTER (WHERE y_spike = 1 AND spike_proba >= t) AS tp,
      count(*) FILTER (WHERE y_spike = 0 AND spike_proba >= t) AS fp,
      count(*) FILTER (WHERE y_spike = 1 AND spike_proba < t) AS fn FROM sc, t GROUP BY name),
    p AS (SELECT *, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision FROM c)
    SELECT *, coalesce(5 * precision * recall / nullif(4 * precision + recall, 0), 0) AS f2 FROM p""",
)
def threshold_table(spark, sf):
    named = {"default": 0.5, "cost": evaluate.cost_threshold(), "third": 0.3}
    return evaluate.threshold_table(A.scored(spark, sf), "spike_proba", "y_spike", named)


@query(
    "score_summary", "y_spike:i mean:d p50:d p95:d n:i",
    SC + """SELECT y_spike, avg(spike_proba) AS mean, median(spike_proba) AS p50,
    quantile_cont(spike_proba, 0.95) AS p95, count(*) AS n FROM sc GROUP BY y_spike""",
)
def score_summary(spark, sf):
    return evaluate.score_summary(A.scored(spark, sf), "spike_proba", "y_spike")


@query(
    "spike_metrics", "zone:s recall:d precision:d f2:d threshold_used:d auc:d",
    SC + """, c AS (SELECT zone, count(*) FILTER (WHERE y_spike = 1 AND spike_proba >= 0.3) AS tp,
      count(*) FILTER (WHERE spike_proba >= 0.3) AS hat, sum(y_spike) AS pos FROM sc GROUP BY zone),
    p AS (SELECT zone, tp / pos AS r, tp / hat::DOUBLE AS p FROM c),
    r AS (SELECT zone, y_spike, rank() OVER (PARTITION BY zone ORDER BY spike_proba) AS r,
      count(*) OVER (PARTITION BY zone, spike_proba) AS t FROM sc),
    a AS (SELECT zone, sum(r + (t - 1) / 2.0) FILTER (WHERE y_spike = 1) AS s, sum(y_spike) AS n1, count(*) AS n
      FROM r GROUP BY zone)
    SELECT zone, p.r AS recall, p AS precision, 5 * p * p.r / (4 * p + p.r) AS f2, 0.3 AS threshold_used,
      (s - n1 * (n1 + 1) / 2.0) / (n1 * (n - n1)) AS auc FROM p JOIN a USING (zone)""",
)
def spike_metrics(spark, sf):
    return evaluate.eval_spike(A.scored(spark, sf), "spike_proba", "y_spike", 0.3, ["zone"])


@query(
    "backtest_spot_card",
    "zone:s hours:i hours_with_forecast:i forecast_share:d mae:d coverage:d bias:d",
    FCQ + """, r AS (SELECT DISTINCT zone, generated_at FROM fc),
    a AS (SELECT d.*, r.generated_at FROM dpr d ASOF LEFT JOIN r ON d.zone = r.zone AND d.ts >= r.generated_at),
    j AS (SELECT a.zone, a.price_eur_mwh AS y, f.p05, f.p50, f.p95
      FROM a LEFT JOIN fc f ON a.zone = f.zone AND a.ts = f.ts AND a.generated_at = f.generated_at)
    SELECT zone, count(*) AS hours, count(p50) AS hours_with_forecast,
      100.0 * avg(CAST(p50 IS NOT NULL AS INT)) AS forecast_share, avg(abs(p50 - y)) AS mae,
      100.0 * avg(CAST(y >= p05 AND y <= p95 AS INT)) FILTER (WHERE p50 IS NOT NULL AND y IS NOT NULL) AS coverage,
      avg(p50 - y) AS bias FROM j GROUP BY zone""",
)
def backtest_spot_card(spark, sf):
    from gridtide.operators.joins import asof_run

    actual = A.dense_prices(spark, sf).withColumnRenamed("price_eur_mwh", "y")
    return evaluate.backtest_spot(asof_run(actual, A.forecast_runs(spark, sf)), ["zone"])


@query(
    "backtest_imbalance_card",
    "zone:s n:i days:i mae:d rmse:d direction_pct:d coverage:d spike_recall:d",
    FCQ + f""", b AS (SELECT * FROM fc WHERE generated_at <= ts
      QUALIFY row_number() OVER (PARTITION BY zone, ts ORDER BY generated_at DESC) = 1),
    j AS (SELECT d.zone, d.ts, d.price_eur_mwh AS y, p05, p50, p95, spike_proba
      FROM dpr d LEFT JOIN b ON d.zone = b.zone AND d.ts = b.ts),
    n AS (SELECT zone, count(*) AS n, date_diff('day', min(CAST({P.local('ts')} AS DATE)),
      max(CAST({P.local('ts')} AS DATE))) + 1 AS days FROM j GROUP BY zone),
    f AS (SELECT *, sign(p50 - lag(p50) OVER ({BY})) = sign(y - lag(y) OVER ({BY})) AS agree
      FROM j WHERE y IS NOT NULL AND p50 IS NOT NULL),
    s AS (SELECT zone, avg(abs(p50 - y)) AS mae, sqrt(avg((p50 - y) * (p50 - y))) AS rmse,
      100.0 * avg(CAST(agree AS INT)) AS direction_pct,
      100.0 * avg(CAST(y >= p05 AND y <= p95 AS INT)) AS coverage,
      100.0 * avg(CAST(spike_proba >= 0.3 AS INT)) FILTER (WHERE y > 60) AS spike_recall FROM f GROUP BY zone)
    SELECT * FROM n JOIN s USING (zone)""",
)
def backtest_imbalance_card(spark, sf):
    from gridtide.operators.joins import asof_row

    actual = A.dense_prices(spark, sf).withColumnRenamed("price_eur_mwh", "y")
    j = asof_row(actual, A.forecast_runs(spark, sf), ["p05", "p50", "p95", "spike_proba"])
    return evaluate.backtest_imbalance(j, HOURLY, threshold=0.3, spike=is_spike("y", 60.0, None))


@query(
    "residuals", "zone:s ts:t residual:d",
    SC + "SELECT zone, ts, least(greatest(p50 - y, -30), 30) AS residual FROM sc",
)
def residuals(spark, sf):
    return evaluate.residuals(A.scored(spark, sf), 30.0)


@query(
    "recent_metrics",
    "n_periods:i n_actual_spikes:i n_predicted:i n_tp:i recall:d precision:d f2:d fpr:d pi_coverage:d mae:d "
    "spike_prevalence:d mean_price:d season:s",
    SC + f""", w AS (SELECT *, y > 60 AS hit, spike_proba >= 0.3 AS hat FROM sc WHERE ts >= {NOW_SQL} - INTERVAL 14 DAY),
    c AS (SELECT count(*) AS n_periods, count(*) FILTER (WHERE hit) AS n_actual_spikes,
      count(*) FILTER (WHERE hat) AS n_predicted, count(*) FILTER (WHERE hit AND hat) AS n_tp,
      count(*) FILTER (WHERE NOT hit AND hat) AS fp, avg(CAST(y >= p05 AND y <= p95 AS INT)) AS pi_coverage,
      avg(abs(p50 - y)) AS mae, avg(CAST(hit AS INT)) AS spike_prevalence, avg(y) AS mean_price FROM w),
    p AS (SELECT *, n_tp / greatest(n_actual_spikes, 1)::DOUBLE AS recall, n_tp / greatest(n_predicted, 1)::DOUBLE AS precision FROM c)
    SELECT *, 5 * precision * recall / greatest(4 * precision + recall, 1e-9) AS f2,
      fp / greatest(n_periods - n_actual_spikes, 1)::DOUBLE AS fpr, 'winter' AS season FROM p""",
)
def recent_metrics(spark, sf):
    return evaluate.recent_metrics(A.scored(spark, sf), 0.3, 14, now(), is_spike("y", 60.0, None))


# --- read side ---------------------------------------------------------------------


@query(
    "price_snapshot",
    "zone:s ts:t current_price:d avg_24h:d min_24h:d max_24h:d mean_7d:d std_7d:d z_score:d anomaly:s peak_48h:d peak_ts:t",
    PR + """, r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY ts DESC) AS rn FROM pr QUALIFY rn <= 168),
    s AS (SELECT zone, max(ts) AS ts, max(price_eur_mwh) FILTER (WHERE rn = 1) AS current_price,
      avg(price_eur_mwh) FILTER (WHERE rn <= 24) AS avg_24h, min(price_eur_mwh) FILTER (WHERE rn <= 24) AS min_24h,
      max(price_eur_mwh) FILTER (WHERE rn <= 24) AS max_24h, avg(price_eur_mwh) AS mean_7d,
      stddev_samp(price_eur_mwh) AS std_7d, max(price_eur_mwh) FILTER (WHERE rn <= 48) AS peak_48h,
      arg_max(ts, (price_eur_mwh, rn)) FILTER (WHERE rn <= 48) AS peak_ts FROM r GROUP BY zone),
    z AS (SELECT *, CASE WHEN std_7d > 0 THEN (current_price - mean_7d) / std_7d ELSE 0 END AS z_score FROM s)
    SELECT *, CASE WHEN z_score > 2 THEN 'high' WHEN z_score < -2 THEN 'low' ELSE 'normal' END AS anomaly FROM z""",
)
def price_snapshot(spark, sf):
    return serve.price_snapshot(A.prices(spark, sf))


@query(
    "price_series_72h", "zone:s ts:t price_eur_mwh:d",
    PR + f"SELECT * FROM pr WHERE ts >= {NOW_SQL} - INTERVAL 72 HOUR",
)
def price_series_72h(spark, sf):
    return serve.price_series(A.prices(spark, sf), now())


@query(
    "recent_prices", "zone:s ts:t price_eur_mwh:d",
    PR + "SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY zone ORDER BY ts DESC) <= 24",
)
def recent_prices(spark, sf):
    return serve.recent_prices(A.prices(spark, sf), 24)


@query(
    "forecast_now", "zone:s ts:t p50:d actual_price:d forecast_vs_current_delta:d",
    FCQ + """, l AS (SELECT * FROM fc QUALIFY generated_at = max(generated_at) OVER (PARTITION BY zone)),
    a AS (SELECT zone, arg_max(price_eur_mwh, ts) AS actual_price FROM pr GROUP BY zone)
    SELECT *, p50 - actual_price AS forecast_vs_current_delta FROM l JOIN a USING (zone)""",
)
def forecast_now(spark, sf):
    return serve.forecast_now(A.forecast_runs(spark, sf), A.prices(spark, sf))


@query(
    "forecast_snapshot",
    "zone:s next_p05:d next_p50:d next_p95:d avg_p50_12h:d mean_abs_error:d max_abs_error:d bias:d n:i rating:s",
    FCQ + f""", m AS (SELECT * FROM fc WHERE generated_at <= {NOW_SQL}
      QUALIFY generated_at = max(generated_at) OVER (PARTITION BY zone)),
    u AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY ts) AS rn FROM m WHERE ts >= {NOW_SQL} QUALIFY rn <= 12),
    h AS (SELECT zone, arg_min(p05, ts) AS next_p05, arg_min(p50, ts) AS next_p50, arg_min(p95, ts) AS next_p95,
      avg(p50) AS avg_p50_12h FROM u GROUP BY zone),
    b AS (SELECT * FROM fc WHERE generated_at <= ts
      QUALIFY row_number() OVER (PARTITION BY zone, ts ORDER BY generated_at DESC) = 1),
    e AS (SELECT p.zone, b.p50 - p.price_eur_mwh AS e FROM pr p JOIN b ON p.zone = b.zone AND p.ts = b.ts
      WHERE p.ts >= {NOW_SQL} - INTERVAL 24 HOUR AND p.ts < {NOW_SQL}),
    a AS (SELECT zone, avg(abs(e)) AS mean_abs_error, max(abs(e)) AS max_abs_error, avg(e) AS bias, count(*) AS n FROM e GROUP BY zone)
    SELECT *, CASE WHEN mean_abs_error < 10 THEN 'good' WHEN mean_abs_error < 25 THEN 'moderate' ELSE 'poor' END AS rating
    FROM h LEFT JOIN a USING (zone)""",
)
def forecast_snapshot(spark, sf):
    return serve.forecast_snapshot(A.forecast_runs(spark, sf), A.prices(spark, sf), now())


@query(
    "forecast_series_48h", "zone:s ts:t p05:d p50:d p95:d",
    FCQ + f""", m AS (SELECT * FROM fc WHERE generated_at <= {NOW_SQL}
      QUALIFY generated_at = max(generated_at) OVER (PARTITION BY zone))
    SELECT * FROM m WHERE ts >= {NOW_SQL} QUALIFY row_number() OVER (PARTITION BY zone ORDER BY ts) <= 48""",
)
def forecast_series_48h(spark, sf):
    return serve.forecast_series(A.forecast_runs(spark, sf), now())


@query(
    "weather_snapshot", "zone:s ts:t temperature:d cloudcover:d fcst_temperature:d smhi_wind_speed_ms:d",
    P.with_parts(P.EVENTS, P.WEATHER, P.WEATHER_FORECAST)
    + """SELECT wx.*, fcst_temperature, NULL AS smhi_wind_speed_ms FROM wx LEFT JOIN wf USING (zone, ts)
    QUALIFY row_number() OVER (PARTITION BY zone ORDER BY ts DESC) = 1""",
)
def weather_snapshot(spark, sf):
    view = master.weather_view(
        A.weather(spark, sf),
        {"fcst": (A.weather_forecast(spark, sf), WF), "smhi": (None, ["smhi_wind_speed_ms"])},
    )
    return serve.weather_snapshot(view)


@query(
    "forecast_page_table", "zone:s ts:t generated_at:t p50:d",
    FCQ + """, l AS (SELECT * FROM fc QUALIFY generated_at = max(generated_at) OVER (PARTITION BY zone))
    SELECT * FROM l WHERE ts >= TIMESTAMP '2024-01-31 06:00:00'""",
)
def forecast_page_table(spark, sf):
    at = F.lit("2024-01-31 06:20:00").cast("timestamp")
    return serve.forecast_page(A.forecast_runs(spark, sf), at)[1]


@query(
    "status_table", "zone:s ts:t actual:s time:s p50:d",
    FCQ + f""", l AS (SELECT * FROM fc WHERE generated_at <= {NOW_SQL})
    SELECT l.zone, l.ts, l.p50, CASE WHEN price_eur_mwh IS NOT NULL THEN printf('%.1f', round(price_eur_mwh + 1e-9, 1))
      WHEN l.ts > {NOW_SQL} THEN '—' ELSE 'pending' END AS actual,
      strftime({P.local('l.ts')}, '%d %b %H:%M') AS time
    FROM l LEFT JOIN (SELECT * FROM pr WHERE ts < {NOW_SQL} - INTERVAL 8 HOUR) p ON l.zone = p.zone AND l.ts = p.ts""",
)
def status_table(spark, sf):
    fc = A.forecast_runs(spark, sf).where(F.col("generated_at") <= now())
    actual = A.prices(spark, sf).where(F.col("ts") < now() - F.expr("INTERVAL 8 HOURS"))
    return serve.status_table(fc, actual, now(), "price_eur_mwh")


def _imbalance_page(spark, sf):
    """Forecast runs spread over quarter hours, with regimes."""
    from gridtide.functions.scalars import regime

    fc = A.forecast_runs(spark, sf)
    runs = fc.withColumn("ts", F.explode(F.sequence("ts", F.col("ts") + F.expr("INTERVAL 45 MINUTES"), F.expr("INTERVAL 15 MINUTES"))))
    runs = runs.withColumn("regime", regime("spike_proba", F.col("p50") - 30, "p05"))
    return serve.imbalance_page(A.dense_imbalance(spark, sf), runs, F.lit("2024-01-31 00:20:00").cast("timestamp"))


@query(
    "imbalance_page_segments", "zone:s start:t last:t regime:s slots:i",
    FCQ + """, l AS (SELECT * FROM fc QUALIFY generated_at = max(generated_at) OVER (PARTITION BY zone)),
    q AS (SELECT zone, unnest(generate_series(ts, ts + INTERVAL 45 MINUTE, INTERVAL 15 MINUTE)) AS ts,
      CASE WHEN spike_proba >= 0.45 THEN 'extreme' WHEN spike_proba >= 0.15 THEN 'stress'
      WHEN p50 < 30 AND p05 < -100 THEN 'deep_long' WHEN p50 < 30 THEN 'normal_long' ELSE 'normal_short' END AS regime FROM l),
    h AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY zone ORDER BY ts) <= 96),
    c AS (SELECT *, CASE WHEN regime = lag(regime) OVER w AND ts - lag(ts) OVER w = INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS chg
      FROM h WINDOW w AS (PARTITION BY zone ORDER BY ts)),
    g AS (SELECT *, sum(chg) OVER (PARTITION BY zone ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM c)
    SELECT zone, min(ts) AS start, max(ts) AS last, regime, count(*) AS slots FROM g GROUP BY zone, grp, regime""",
)
def imbalance_page_segments(spark, sf):
    return _imbalance_page(spark, sf)["segments"].withColumnRenamed("end", "last")


@query(
    "imbalance_page_direction", "zone:s n_long:i n_neutral:i n_short:i pct_short:d",
    P.with_parts(P.EVENTS, P.IMBALANCE, P.DENSE_IMBALANCE)
    + """, w AS (SELECT * FROM dimb WHERE ts >= TIMESTAMP '2024-01-31 00:20:00' - INTERVAL 168 HOUR)
    SELECT zone, count(*) FILTER (WHERE direction < 0) AS n_long, count(*) FILTER (WHERE direction = 0) AS n_neutral,
    count(*) FILTER (WHERE direction > 0) AS n_short,
    100.0 * count(*) FILTER (WHERE direction > 0) / count(direction) AS pct_short FROM w GROUP BY zone""",
)
def imbalance_page_direction(spark, sf):
    return _imbalance_page(spark, sf)["direction"]


@query(
    "performance_card", "n:i mae:d night_mae:d peak_mae:d",
    SC + f""", e AS (SELECT abs(p50 - y) AS a, hour({P.local('ts')}) AS h FROM sc)
    SELECT count(*) AS n, avg(a) AS mae, avg(a) FILTER (WHERE h IN (23,0,1,2,3,4,5)) AS night_mae,
    avg(a) FILTER (WHERE h IN (7,8,9,17,18,19,20)) AS peak_mae FROM e""",
)
def performance_card(spark, sf):
    return serve.performance(A.scored(spark, sf))[0]


@query(
    "backtest_range_card", "hours:i mae:d coverage:d bias:d",
    SC + f"""SELECT count(*) AS hours, avg(abs(p50 - y)) AS mae, 100.0 * avg(CAST(y >= p05 AND y <= p95 AS INT)) AS coverage,
    avg(p50 - y) AS bias FROM sc WHERE CAST({P.local('ts')} AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-20'""",
)
def backtest_range_card(spark, sf):
    return serve.backtest(A.scored(spark, sf), "2024-01-08", "2024-01-20")["card"]


@query(
    "explore_range_stats", "zone:s mean:d min:d max:d std:d n:i",
    P.with_parts(P.EVENTS, P.GENERATION) + """SELECT zone, avg(load_mw) AS mean, min(load_mw) AS min, max(load_mw) AS max,
    stddev_samp(load_mw) AS std, count(load_mw) AS n FROM gen
    WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-19 18:00:00' GROUP BY zone""",
)
def explore_range_stats(spark, sf):
    return serve.explore(A.generation(spark, sf), "2024-01-03", "2024-01-19 18:00:00", "load_mw")[1]


@query(
    "freshness", "table_name:s generated_at:t age_minutes:i band:s label:s",
    FCQ + """, f AS (SELECT 'forecasts' AS table_name, max(generated_at) AS generated_at FROM fc
      UNION ALL SELECT 'earlier', max(generated_at) FROM fc WHERE generated_at < TIMESTAMP '2024-01-31 12:00:00'),
    a AS (SELECT *, CAST(epoch(TIMESTAMP '2024-02-01 06:30:00' - generated_at) / 60 AS BIGINT) AS age_minutes FROM f)
    SELECT *, CASE WHEN age_minutes < 180 THEN 'ok' WHEN age_minutes < 720 THEN 'warn' ELSE 'stale' END AS band,
      CASE WHEN age_minutes < 60 THEN age_minutes || ' min' WHEN age_minutes < 1440 THEN (age_minutes // 60) || ' h'
      ELSE (age_minutes // 1440) || ' d' END AS label FROM a""",
)
def freshness(spark, sf):
    fc = A.forecast_runs(spark, sf)
    early = fc.where(F.col("generated_at") < F.lit("2024-01-31 12:00:00").cast("timestamp"))
    return serve.freshness({"forecasts": fc, "earlier": early}, F.lit("2024-02-01 06:30:00").cast("timestamp"))


@query(
    "recent_weather", "zone:s ts:t temperature:d windspeed_100m:d cloudcover:d",
    P.with_parts(P.EVENTS, P.WEATHER) + "SELECT * FROM wx QUALIFY row_number() OVER (PARTITION BY zone ORDER BY ts DESC) <= 24",
)
def recent_weather(spark, sf):
    return serve.recent_weather(A.weather(spark, sf), 24)


@query(
    "weather_range", "zone:s ts:t temperature:d fcst_temperature:d",
    P.with_parts(P.EVENTS, P.WEATHER, P.WEATHER_FORECAST)
    + """SELECT wx.zone, wx.ts, temperature, fcst_temperature FROM wx LEFT JOIN wf USING (zone, ts)
    WHERE wx.ts BETWEEN TIMESTAMP '2024-01-04' AND TIMESTAMP '2024-01-12 06:00:00'""",
)
def weather_range(spark, sf):
    """Weather of a range with the forecast beside it."""
    view = master.weather_view(A.weather(spark, sf), {"fcst": (A.weather_forecast(spark, sf), WF)})
    return serve.explore(view, "2024-01-04", "2024-01-12 06:00:00", "temperature")[0]


_PAGE_SQL = """TIMESTAMP '2024-01-31 00:20:00'"""


@query(
    "imbalance_page_settled", "zone:s imbl_price:d ts:t age_minutes:i",
    P.with_parts(P.EVENTS, P.IMBALANCE)
    + f"""SELECT zone, arg_max(imbl_price, ts) AS imbl_price, max(ts) AS ts,
      CAST(floor(epoch({_PAGE_SQL} - max(ts)) / 60) AS BIGINT) AS age_minutes
    FROM imb WHERE imbl_price IS NOT NULL AND ts >= {_PAGE_SQL} - INTERVAL 168 HOUR GROUP BY zone""",
)
def imbalance_page_settled(spark, sf):
    return _imbalance_page(spark, sf)["settled"]


@query(
    "imbalance_page_actuals", "zone:s ts:t imbl_price:d",
    P.with_parts(P.EVENTS, P.IMBALANCE, P.DENSE_IMBALANCE) + f"SELECT zone, ts, imbl_price FROM dimb WHERE ts >= {_PAGE_SQL} - INTERVAL 48 HOUR",
)
def imbalance_page_actuals(spark, sf):
    return _imbalance_page(spark, sf)["actuals"]


@query(
    "imbalance_page_forecast", "zone:s ts:t p50:d actual:s",
    FCQ + f""", l AS (SELECT * FROM fc QUALIFY generated_at = max(generated_at) OVER (PARTITION BY zone)),
    q AS (SELECT zone, p50, unnest(generate_series(ts, ts + INTERVAL 45 MINUTE, INTERVAL 15 MINUTE)) AS ts FROM l),
    h AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY zone ORDER BY ts) <= 96),
    {P.IMBALANCE}
    SELECT h.zone, h.ts, p50, CASE WHEN imbl_price IS NOT NULL THEN printf('%.1f', round(imbl_price + 1e-9, 1))
      WHEN h.ts > {_PAGE_SQL} THEN '—' ELSE 'pending' END AS actual
    FROM h LEFT JOIN imb ON h.zone = imb.zone AND h.ts = imb.ts""",
)
def imbalance_page_forecast(spark, sf):
    return _imbalance_page(spark, sf)["forecast"]


_RANGE = SC + f", r AS (SELECT *, {P.local('ts')} AS l FROM sc WHERE CAST({P.local('ts')} AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-20')"


def _backtest(spark, sf):
    return serve.backtest(A.scored(spark, sf), "2024-01-08", "2024-01-20")


@query("backtest_range_daily", "day:s mae:d", _RANGE + " SELECT strftime(l, '%Y-%m-%d') AS day, avg(abs(p50 - y)) AS mae FROM r GROUP BY ALL")
def backtest_range_daily(spark, sf):
    return _backtest(spark, sf)["daily"]


@query("backtest_range_hours", "hour:i mae:d", _RANGE + " SELECT hour(l) AS hour, avg(abs(p50 - y)) AS mae FROM r GROUP BY ALL")
def backtest_range_hours(spark, sf):
    return _backtest(spark, sf)["by_hour"]


@query(
    "backtest_range_distribution", "mean:d median:d std:d min:d max:d",
    _RANGE + " SELECT avg(y) AS mean, median(y) AS median, stddev_samp(y) AS std, min(y) AS min, max(y) AS max FROM r",
)
def backtest_range_distribution(spark, sf):
    return _backtest(spark, sf)["distribution"]


@query(
    "backtest_range_histogram", "bin:i n:i",
    _RANGE + """, e AS (SELECT least(greatest(p50 - y, -300), 300) AS x FROM r), b AS (SELECT min(x) AS lo, max(x) AS hi FROM e),
    k AS (SELECT least(floor((x - lo) / ((hi - lo) / 40)), 39) AS bin, count(*) AS n FROM e, b GROUP BY ALL)
    SELECT g.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(40)) AS bin) g LEFT JOIN k ON g.bin = k.bin""",
)
def backtest_range_histogram(spark, sf):
    return _backtest(spark, sf)["histogram"]
