"""Registered queries over time alignment, sources and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.catalog import sql_parts as P
from gridtide.catalog.core import query
from gridtide.features.spot import ANCHOR_WEIGHTS
from gridtide.operators import grid, windows
from gridtide.operators.blocks import HOURLY, QUARTER
from gridtide.plans import adapters as A

IMB = P.with_parts(P.EVENTS, P.IMBALANCE)
DIMB = P.with_parts(P.EVENTS, P.IMBALANCE, P.DENSE_IMBALANCE)
DPR = P.with_parts(P.EVENTS, P.PRICES, P.DENSE_PRICES)
PR = P.with_parts(P.EVENTS, P.PRICES)
BY = "PARTITION BY zone ORDER BY ts"


@query(
    "hourly_resample",
    "zone:s ts:t mean:d low:d high:d n:i",
    P.with_parts(P.EVENTS)
    + """SELECT zone, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(value) AS mean,
    min(value) AS low, max(value) AS high, count(value) AS n FROM ev GROUP BY ALL""",
)
def hourly_resample(spark, sf):
    aggs = {"mean": F.avg("value"), "low": F.min("value"), "high": F.max("value"), "n": F.count("value")}
    return grid.resample(A.events(spark, sf), HOURLY, aggs)


@query(
    "resample_median_hourly",
    "zone:s ts:t price:d",
    P.with_parts(P.EVENTS)
    + """SELECT zone, time_bucket(INTERVAL 1 HOUR, ts) AS ts, median(value) AS price
    FROM ev GROUP BY ALL""",
)
def resample_median_hourly(spark, sf):
    return grid.resample_median(A.events(spark, sf), HOURLY, "value", "price")


@query(
    "resample_local_day",
    "zone:s day:t mean:d",
    P.with_parts(P.EVENTS)
    + f"""SELECT zone, date_trunc('day', {P.local('ts')}) AS day, avg(value) AS mean
    FROM ev GROUP BY ALL""",
)
def resample_local_day(spark, sf):
    e = A.events(spark, sf)
    return e.groupBy("zone", grid.local_bucket("ts", "day").alias("day")).agg(F.avg("value").alias("mean"))


@query(
    "densify_ffill",
    "zone:s ts:t imbl_price:d",
    DIMB
    + f"""SELECT zone, ts, last_value(imbl_price IGNORE NULLS)
    OVER ({BY} ROWS UNBOUNDED PRECEDING) AS imbl_price FROM dimb""",
)
def densify_ffill(spark, sf):
    return grid.ffill(A.dense_imbalance(spark, sf), QUARTER, ["imbl_price"])


def _ffill_sql(limit: int) -> str:
    return DIMB + f"""SELECT zone, ts, last_value(imbl_price IGNORE NULLS)
    OVER ({BY} ROWS {limit} PRECEDING) AS imbl_price FROM dimb"""


@query("ffill_limit_3", "zone:s ts:t imbl_price:d", _ffill_sql(3))
def ffill_limit_3(spark, sf):
    return grid.ffill(A.dense_imbalance(spark, sf), QUARTER, ["imbl_price"], limit=3)


@query(
    "ffill_limit_12_zero",
    "zone:s ts:t imbl_price:d",
    f"SELECT zone, ts, coalesce(imbl_price, 0) AS imbl_price FROM ({_ffill_sql(12)})",
)
def ffill_limit_12_zero(spark, sf):
    return grid.ffill(A.dense_imbalance(spark, sf), QUARTER, ["imbl_price"], limit=12, fill=0.0)


@query(
    "densify_explicit_range",
    "zone:s ts:t imbl_price:d",
    IMB
    + """, grid AS (SELECT zone, unnest(generate_series(TIMESTAMP '2023-12-31 22:00:00',
    TIMESTAMP '2024-01-31 02:00:00', INTERVAL 15 MINUTE)) AS ts FROM (SELECT DISTINCT zone FROM imb))
    SELECT g.zone, g.ts, i.imbl_price FROM grid g LEFT JOIN imb i ON g.zone = i.zone AND g.ts = i.ts""",
)
def densify_explicit_range(spark, sf):
    return grid.densify(
        A.imbalance(spark, sf), QUARTER, "2023-12-31 22:00:00", "2024-01-31 02:00:00"
    )


@query(
    "upsample_spot_15min",
    "zone:s ts:t spot_price:d",
    PR
    + f""", span AS (SELECT zone, min(ts) AS lo, max(ts) AS hi FROM pr GROUP BY zone),
    grid AS (SELECT zone, unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS ts FROM span)
    SELECT g.zone, g.ts, last_value(p.price_eur_mwh IGNORE NULLS)
      OVER (PARTITION BY g.zone ORDER BY g.ts ROWS 4 PRECEDING) AS spot_price
    FROM grid g LEFT JOIN pr p ON g.zone = p.zone AND g.ts = p.ts""",
)
def upsample_spot_15min(spark, sf):
    p = A.prices(spark, sf).withColumnRenamed("price_eur_mwh", "spot_price")
    return grid.upsample(p, QUARTER, ["spot_price"], limit=4)


@query(
    "bucket_modes",
    "zone:s lo:t mid:t hi:t n:i",
    P.with_parts(P.EVENTS)
    + """SELECT zone, to_timestamp(floor(epoch_us(ts) / 9e8) * 900)::TIMESTAMP AS lo,
    to_timestamp(floor(epoch_us(ts) / 9e8 + 0.5) * 900)::TIMESTAMP AS mid,
    to_timestamp(ceil(epoch_us(ts) / 9e8) * 900)::TIMESTAMP AS hi, count(*) AS n FROM ev GROUP BY ALL""",
)
def bucket_modes(spark, sf):
    e = A.events(spark, sf)
    modes = {"lo": "floor", "mid": "round", "hi": "ceil"}
    return e.groupBy("zone", *[grid.bucket("ts", 900, m).alias(c) for c, m in modes.items()]).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "future_slots",
    "zone:s ts:t",
    IMB
    + """, hi AS (SELECT zone, max(ts) AS hi FROM imb GROUP BY zone)
    SELECT zone, unnest(generate_series(hi + INTERVAL 15 MINUTE, hi + INTERVAL 24 HOUR,
    INTERVAL 15 MINUTE)) AS ts FROM hi""",
)
def future_slots(spark, sf):
    return grid.future_grid(A.imbalance(spark, sf), QUARTER, 96)


@query(
    "interior_gaps",
    "zone:s gap_after:t gap_before:t missing:i",
    IMB
    + f"""SELECT zone, prev AS gap_after, ts AS gap_before,
    CAST(epoch(ts - prev) / 900 AS BIGINT) - 1 AS missing
    FROM (SELECT zone, ts, lag(ts) OVER ({BY}) AS prev FROM imb)
    WHERE ts - prev > INTERVAL 15 MINUTE""",
)
def interior_gaps(spark, sf):
    return grid.interior_gaps(A.imbalance(spark, sf), QUARTER)


# --- windows -----------------------------------------------------------------


@query(
    "imbalance_lags",
    "zone:s ts:t imbl_lag_1:d imbl_lag_4:d imbl_lag_16:d",
    DIMB
    + f"""SELECT zone, ts, lag(imbl_price, 1) OVER w AS imbl_lag_1,
    lag(imbl_price, 4) OVER w AS imbl_lag_4, lag(imbl_price, 16) OVER w AS imbl_lag_16
    FROM dimb WINDOW w AS ({BY})""",
)
def imbalance_lags(spark, sf):
    return windows.lag(A.dense_imbalance(spark, sf), QUARTER, "imbl_price", [1, 4, 16], "imbl_lag")


@query(
    "lead_target",
    "zone:s ts:t target_price:d",
    DIMB + f"SELECT zone, ts, lead(imbl_price, 1) OVER ({BY}) AS target_price FROM dimb",
)
def lead_target(spark, sf):
    return windows.lead(A.dense_imbalance(spark, sf), QUARTER, "imbl_price", 1, "target_price")


def _roll_sql(n: int, m: int | None = None, aggs=("mean",)) -> str:
    fn = {"mean": "avg", "std": "stddev_samp", "max": "max", "min": "min", "sum": "sum"}
    cols = ", ".join(
        f"CASE WHEN count(imbl_price) OVER w >= {m or n} THEN {fn[a]}(imbl_price) OVER w END AS roll_{a}"
        for a in aggs
    )
    return DIMB + f"SELECT zone, ts, {cols} FROM dimb WINDOW w AS ({BY} ROWS {n - 1} PRECEDING)"


@query(
    "rolling_full",
    "zone:s ts:t roll_mean:d roll_std:d roll_max:d roll_min:d roll_sum:d",
    _roll_sql(4, None, ("mean", "std", "max", "min", "sum")),
)
def rolling_full(spark, sf):
    df = A.dense_imbalance(spark, sf)
    return windows.rolling(df, QUARTER, "imbl_price", 4, ["mean", "std", "max", "min", "sum"], prefix="roll")


@query("rolling_minperiods", "zone:s ts:t roll_mean:d", _roll_sql(672, 48))
def rolling_minperiods(spark, sf):
    return windows.rolling(
        A.dense_imbalance(spark, sf), QUARTER, "imbl_price", 672, ["mean"], 48, prefix="roll", wide=True
    )


@query(
    "ewm_span8",
    "zone:s ts:t ewa:d",
    DIMB
    + f""", seq AS (SELECT zone, ts, imbl_price AS x,
      row_number() OVER ({BY}) AS rn FROM dimb),
    vals AS (SELECT zone, ts, rn, x, row_number() OVER ({BY}) AS vn,
      rn - lag(rn) OVER ({BY}) AS gap FROM seq WHERE x IS NOT NULL),
    lists AS (SELECT zone, vn, ts, list(struct_pack(x := x, g := gap)) OVER
      ({BY} ROWS 150 PRECEDING) AS l FROM vals),
    folded AS (SELECT zone, ts, list_reduce(
        list_transform(l, lambda e: struct_pack(y := e.x, g := e.g)),
        lambda a, e: struct_pack(
          y := (pow(7.0/9.0, e.g) * a.y + 2.0/9.0 * e.y) / (pow(7.0/9.0, e.g) + 2.0/9.0), g := e.g)).y AS y
      FROM lists)
    SELECT s.zone, s.ts, last_value(f.y IGNORE NULLS) OVER
      (PARTITION BY s.zone ORDER BY s.ts ROWS UNBOUNDED PRECEDING) AS ewa
    FROM seq s LEFT JOIN folded f ON s.zone = f.zone AND s.ts = f.ts""",
)
def ewm_span8(spark, sf):
    return windows.ewm(A.dense_imbalance(spark, sf), QUARTER, "imbl_price", "ewa", 8)


@query(
    "seasonal_ewa",
    "zone:s ts:t price_ewa:d",
    DPR
    + "SELECT zone, ts, "
    + " + ".join(f"lag(price_eur_mwh, {n}) OVER w * {x}" for n, x in ANCHOR_WEIGHTS.items())
    + f" AS price_ewa FROM dpr WINDOW w AS ({BY})",
)
def seasonal_ewa(spark, sf):
    return windows.seasonal_mean(
        A.dense_prices(spark, sf), HOURLY, "price_eur_mwh", ANCHOR_WEIGHTS, "price_ewa"
    )


@query(
    "same_hour_mean_3d",
    "zone:s ts:t mean_3d:d",
    DPR
    + f"""SELECT zone, ts, (lag(price_eur_mwh, 24) OVER w + lag(price_eur_mwh, 48) OVER w
    + lag(price_eur_mwh, 72) OVER w) / 3 AS mean_3d FROM dpr WINDOW w AS ({BY})""",
)
def same_hour_mean_3d(spark, sf):
    return windows.same_hour_mean(A.dense_prices(spark, sf), HOURLY, "price_eur_mwh", 3, "mean_3d")


_D12 = DIMB + f""", d AS (SELECT *, row_number() OVER w AS rn, lag(direction, 1) OVER w AS d1,
  lag(direction, 2) OVER w AS d2, lag(imbl_price, 1) OVER w AS p1 FROM dimb WINDOW w AS ({BY}))"""


@query(
    "direction_streak",
    "zone:s ts:t dir_streak:i",
    _D12
    + f""", g AS (SELECT *, sum(CASE WHEN d1 = d2 THEN 0 ELSE 1 END) OVER
      ({BY} ROWS UNBOUNDED PRECEDING) AS grp FROM d)
    SELECT zone, ts, row_number() OVER (PARTITION BY zone, grp ORDER BY ts) AS dir_streak FROM g""",
)
def direction_streak(spark, sf):
    return windows.streak(A.dense_imbalance(spark, sf), QUARTER, "direction", "dir_streak")


_STRESS = _D12 + """, f AS (SELECT zone, ts, rn,
  CASE WHEN abs(p1) > 60 THEN 1 ELSE 0 END AS s FROM d)"""


@query(
    "consecutive_stress",
    "zone:s ts:t consecutive_stress:i",
    _STRESS
    + f""", c AS (SELECT *, CASE WHEN s = lag(s) OVER ({BY}) THEN 0 ELSE 1 END AS chg FROM f),
    g AS (SELECT *, sum(chg) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS grp FROM c)
    SELECT zone, ts, (row_number() OVER (PARTITION BY zone, grp ORDER BY ts) - 1) * s
      AS consecutive_stress FROM g""",
)
def consecutive_stress(spark, sf):
    flag = F.abs("imbl_price") > 60
    return windows.run_position(
        A.dense_imbalance(spark, sf), QUARTER, flag, "consecutive_stress", shift=1
    )


@query(
    "periods_since_stress",
    "zone:s ts:t periods_since_stress:i",
    _STRESS
    + f"""SELECT zone, ts, rn - coalesce(max(CASE WHEN s = 1 THEN rn END) OVER
      ({BY} ROWS UNBOUNDED PRECEDING), 0) AS periods_since_stress FROM f""",
)
def periods_since_stress(spark, sf):
    flag = F.abs("imbl_price") > 60
    return windows.since_last(
        A.dense_imbalance(spark, sf), QUARTER, flag, "periods_since_stress", shift=1
    )


@query(
    "flip_rate",
    "zone:s ts:t flips_4:i flips_16:i flips_96:i",
    _D12
    + ", x AS (SELECT zone, ts, rn, CASE WHEN d1 = d2 THEN 0 ELSE 1 END AS flip FROM d)\n"
    + "SELECT zone, ts, "
    + ", ".join(
        f"CASE WHEN rn >= {n} THEN sum(flip) OVER ({BY} ROWS {n - 1} PRECEDING) END AS flips_{n}"
        for n in (4, 16, 96)
    )
    + " FROM x",
)
def flip_rate(spark, sf):
    return windows.flip_counts(A.dense_imbalance(spark, sf), QUARTER, "direction", [4, 16, 96])


@query(
    "regime_flips",
    "zone:s ts:t to_short:i to_long:i",
    _D12
    + """SELECT zone, ts, CASE WHEN d1 = 1 AND d2 = -1 THEN 1 ELSE 0 END AS to_short,
    CASE WHEN d1 = -1 AND d2 = 1 THEN 1 ELSE 0 END AS to_long FROM d""",
)
def regime_flips(spark, sf):
    df = windows.flip_to(A.dense_imbalance(spark, sf), QUARTER, "direction", 1, -1, "to_short")
    return windows.flip_to(df, QUARTER, "direction", -1, 1, "to_long")


@query(
    "price_momentum",
    "zone:s ts:t momentum_1h:d",
    DIMB
    + f"""SELECT zone, ts, lag(imbl_price, 1) OVER w - lag(imbl_price, 5) OVER w AS momentum_1h
    FROM dimb WINDOW w AS ({BY})""",
)
def price_momentum(spark, sf):
    return windows.momentum(A.dense_imbalance(spark, sf), QUARTER, "imbl_price", 1, 5, "momentum_1h")


@query(
    "zscore",
    "zone:s ts:t z:d",
    DIMB
    + f"""SELECT zone, ts, CASE WHEN count(imbl_price) OVER w >= 16 THEN
    (imbl_price - avg(imbl_price) OVER w) / (stddev_samp(imbl_price) OVER w + 1e-6) END AS z
    FROM dimb WINDOW w AS ({BY} ROWS 15 PRECEDING)""",
)
def zscore(spark, sf):
    return windows.zscore(A.dense_imbalance(spark, sf), QUARTER, "imbl_price", 16, "z")


ANOMALY_SQL = PR + f""", st AS (SELECT *, avg(price_eur_mwh) OVER w AS mean_n,
    stddev_samp(price_eur_mwh) OVER w AS std_n FROM dp
    WINDOW w AS ({BY} ROWS 167 PRECEDING)),
  z AS (SELECT *, CASE WHEN std_n > 0 THEN (price_eur_mwh - mean_n) / std_n ELSE 0 END AS z_score FROM st)
  SELECT *, CASE WHEN z_score > 2 THEN 'high' WHEN z_score < -2 THEN 'low' ELSE 'normal' END AS anomaly
  FROM z"""


@query(
    "trailing_anomaly",
    "zone:s ts:t price_eur_mwh:d mean_n:d std_n:d z_score:d anomaly:s",
    ANOMALY_SQL.replace("FROM dp\n", "FROM dpr\n").replace(PR, DPR),
)
def trailing_anomaly(spark, sf):
    return windows.anomaly(A.dense_prices(spark, sf), HOURLY, "price_eur_mwh", 168)


@query(
    "price_shortfall",
    "zone:s ts:t shortfall:d",
    DPR
    + f"""SELECT zone, ts, CASE WHEN count(price_eur_mwh) OVER w >= 168 THEN max(price_eur_mwh) OVER w END
    - price_eur_mwh AS shortfall FROM dpr WINDOW w AS ({BY} ROWS 167 PRECEDING)""",
)
def price_shortfall(spark, sf):
    return windows.shortfall(A.dense_prices(spark, sf), HOURLY, "price_eur_mwh", 168, "shortfall")


@query(
    "spike_neighbourhood",
    "zone:s ts:t near:i",
    DIMB
    + f"""SELECT zone, ts, max(CASE WHEN imbl_price > 60 OR imbl_price < -100 THEN 1 ELSE 0 END)
    OVER ({BY} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM dimb""",
)
def spike_neighbourhood(spark, sf):
    from gridtide.functions.scalars import is_spike

    return windows.near(A.dense_imbalance(spark, sf), QUARTER, is_spike("imbl_price", 60.0, -100.0))


@query(
    "trailing_stats",
    "zone:s ts:t price_eur_mwh_tail168_mean:d price_eur_mwh_tail168_std:d price_eur_mwh_tail168_max:d",
    DPR
    + f"""SELECT zone, ts, avg(price_eur_mwh) OVER w AS price_eur_mwh_tail168_mean,
    stddev_samp(price_eur_mwh) OVER w AS price_eur_mwh_tail168_std,
    max(price_eur_mwh) OVER w AS price_eur_mwh_tail168_max FROM dpr
    WINDOW w AS ({BY} ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)""",
)
def trailing_stats(spark, sf):
    df = A.dense_prices(spark, sf)
    return windows.trailing(df, HOURLY, "price_eur_mwh", 168, ["mean", "std", "max"])


@query(
    "step_agreement",
    "zone:s ts:t agree:i",
    DPR
    + f"""SELECT zone, ts, CAST(sign(price_eur_mwh - lag(price_eur_mwh) OVER w) =
    sign(other - lag(other) OVER w) AS INTEGER) AS agree
    FROM (SELECT *, lag(price_eur_mwh, 24) OVER ({BY}) AS other FROM dpr) WINDOW w AS ({BY})""",
)
def step_agreement(spark, sf):
    df = windows.lag(A.dense_prices(spark, sf), HOURLY, "price_eur_mwh", [24], "other")
    return windows.step_agreement(df, HOURLY, "price_eur_mwh", "other_24", "agree")


@query(
    "regime_segments",
    "zone:s start:t last:t label:s slots:i",
    DIMB
    + f""", r AS (SELECT zone, ts, CASE WHEN imbl_price > 60 THEN 'stress'
      WHEN direction < 0 THEN 'normal_long' ELSE 'normal_short' END AS label FROM dimb),
    c AS (SELECT *, CASE WHEN label = lag(label) OVER ({BY}) THEN 0 ELSE 1 END AS chg FROM r),
    g AS (SELECT *, sum(chg) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS grp FROM c)
    SELECT zone, min(ts) AS start, max(ts) AS last, label, count(*) AS slots
    FROM g GROUP BY zone, grp, label""",
)
def regime_segments(spark, sf):
    label = (
        F.when(F.col("imbl_price") > 60, "stress")
        .when(F.col("direction") < 0, "normal_long")
        .otherwise("normal_short")
    )
    df = A.dense_imbalance(spark, sf).withColumn("label", label)
    return windows.segments(df, QUARTER, "label").withColumnRenamed("end", "last")


@query(
    "last_valid_price",
    "zone:s ts:t imbl_price:d age_minutes:i age:s",
    DIMB
    + """, hi AS (SELECT max(ts) AS now FROM dimb),
    l AS (SELECT zone, max(ts) FILTER (WHERE imbl_price IS NOT NULL) AS ts,
      arg_max(imbl_price, ts) FILTER (WHERE imbl_price IS NOT NULL) AS imbl_price FROM dimb GROUP BY zone),
    a AS (SELECT l.*, CAST(epoch(now - ts) / 60 + 200 AS BIGINT) AS age_minutes FROM l, hi)
    SELECT *, CASE WHEN age_minutes < 60 THEN age_minutes || ' min'
      WHEN age_minutes < 1440 THEN (age_minutes // 60) || ' h' ELSE (age_minutes // 1440) || ' d' END AS age
    FROM a""",
)
def last_valid_price(spark, sf):
    from gridtide.plans.serve import last_valid

    df = A.dense_imbalance(spark, sf)
    now = df.agg((F.max("ts") + F.expr("INTERVAL 200 MINUTES")).alias("_now"))
    return last_valid(df, "imbl_price", now)
