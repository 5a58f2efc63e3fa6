"""Registered queries over calendars, feature matrices and labels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridtide.catalog import sql_parts as P
from gridtide.catalog.align import BY, IMB
from gridtide.catalog.core import query
from gridtide.features import imbalance as fi
from gridtide.features.imbalance import imbalance_features
from gridtide.features import spot as fs
from gridtide.features.spot import ANCHOR_WEIGHTS, spot_features
from gridtide.functions import calendar as cal
from gridtide.functions import scalars
from gridtide.operators import projections, quantiles
from gridtide.operators.blocks import attach
from gridtide.plans import adapters as A
from gridtide.plans import master
from gridtide.sources import feeds

NIGHT = "hour IN (23, 0, 1, 2, 3, 4, 5)"
PEAK = "hour IN (7, 8, 9, 17, 18, 19, 20)"


def calendar_sql(source: str, slots: int) -> str:
    """CTE ``cal`` over (zone, ts) rows of a source with local calendar columns."""
    lt = P.local("ts")
    slot = "hour * 4 + minute // 15" if slots == 96 else "hour"
    return f"""
    lt AS (SELECT *, {lt} AS l FROM {source}),
    c0 AS (SELECT *, CAST(hour(l) AS INTEGER) AS hour, CAST(minute(l) AS INTEGER) AS minute,
      CAST(isodow(l) - 1 AS INTEGER) AS dayofweek, CAST(month(l) AS INTEGER) AS month,
      dayofyear(l) AS doy, year(l) AS yr, CAST(l AS DATE) AS day FROM lt),
    c1 AS (SELECT *, {slot} AS slot FROM c0),
    c2 AS (SELECT *, dayofweek * {slots} + slot AS how, (doy - 1) * {slots} + slot AS hoy FROM c1),
    e0 AS (SELECT yr, (yr % 19) AS a, yr // 100 AS b, yr % 100 AS c FROM (SELECT DISTINCT yr FROM c2)),
    e1 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e0),
    e2 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS m FROM e1),
    e3 AS (SELECT yr, h + m - 7 * ((a + 11 * h + 22 * m) // 451) + 114 AS t FROM e2),
    easter AS (SELECT yr, make_date(yr, t // 31, t % 31 + 1) AS sunday FROM e3),
    cal AS (SELECT c2.*, (month % 12) // 3 + 1 AS season,
      CAST(dayofweek >= 5 AS INTEGER) AS is_weekend,
      CAST({PEAK} AS INTEGER) AS is_peak, CAST({NIGHT} AS INTEGER) AS is_night,
      CAST(month IN (12, 1, 2) AS INTEGER) AS is_winter,
      CAST((month, dayofmonth(l)) IN ((1,1),(1,6),(5,1),(12,24),(12,25),(12,26),(12,31))
        OR (c2.yr >= 2005 AND month = 6 AND dayofmonth(l) = 6)
        OR (c2.yr <= 2004 AND date_diff('day', sunday, day) = 50)
        OR date_diff('day', sunday, day) IN (-2, 0, 1, 39, 49)
        OR (dayofweek = 4 AND month = 6 AND dayofmonth(l) BETWEEN 19 AND 25)
        OR (dayofweek = 5 AND month = 6 AND dayofmonth(l) BETWEEN 20 AND 26)
        OR (dayofweek = 5 AND ((month = 10 AND dayofmonth(l) = 31) OR (month = 11 AND dayofmonth(l) <= 6)))
        AS INTEGER) AS is_holiday
      FROM c2 JOIN easter ON c2.yr = easter.yr)"""


def wave_sql(value: str, period: float, name: str, k: int = 1) -> str:
    w = 2 * math.pi * k
    return (
        f"sin(CAST({value} AS DOUBLE) * {w!r} / {float(period)!r}) AS {name.format('sin')}, "
        f"cos(CAST({value} AS DOUBLE) * {w!r} / {float(period)!r}) AS {name.format('cos')}"
    )


CAL_COLUMNS = (
    "hour:i minute:i dayofweek:i month:i slot:i season:i is_weekend:i is_holiday:i is_peak:i "
    "is_night:i is_winter:i"
)


# Order dates span years, so the calendar queries run over them.
def _order_slots(spark, sf):
    o = A.read(spark, sf, "orders")
    return o.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))


@query(
    "calendar_features",
    "o_orderkey:i " + CAL_COLUMNS + " hour_sin:d hour_cos:d dow_sin:d dow_cos:d month_sin:d month_cos:d slot_sin:d slot_cos:d",
    "WITH src AS (SELECT o_orderkey, o_orderdate AS ts FROM orders),"
    + calendar_sql("src", 96)
    + "SELECT *, "
    + ", ".join(
        wave_sql(v, p, n + "_{}")
        for v, p, n in (("hour", 24, "hour"), ("dayofweek", 7, "dow"), ("month", 12, "month"), ("slot", 96, "slot"))
    )
    + " FROM cal",
)
def calendar_features(spark, sf):
    df = _order_slots(spark, sf).withColumns(cal.calendar_fields("ts"))
    return df.withColumns({**cal.flags(), **cal.cyclic({"hour": 24, "dayofweek": 7, "month": 12, "slot": 96})})


_HARMONICS = [(p, v, n, k) for p, v, n, top in (
    ("daily", "slot", 96, 3), ("weekly", "how", 672, 3), ("annual", "hoy", 35040, 2)
) for k in range(1, top + 1)]


@query(
    "fourier_features",
    "o_orderkey:i " + " ".join(f"{p}_{fn}_k{k}:d" for p, _, _, k in _HARMONICS for fn in ("sin", "cos")),
    "WITH src AS (SELECT o_orderkey, o_orderdate AS ts FROM orders),"
    + calendar_sql("src", 96)
    + "SELECT o_orderkey, "
    + ", ".join(wave_sql(v, n, p + "_{}_k" + str(k), k) for p, v, n, k in _HARMONICS)
    + " FROM cal",
)
def fourier_features(spark, sf):
    df = _order_slots(spark, sf).withColumns(cal.calendar_fields("ts"))
    return df.withColumns(cal.harmonics(F.col("slot"), 96))


@query(
    "holiday_days",
    "day:s n:i",
    "WITH src AS (SELECT o_orderkey, o_orderdate AS ts FROM orders),"
    + calendar_sql("src", 96)
    + "SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM cal WHERE is_holiday = 1 GROUP BY ALL",
)
def holiday_days(spark, sf):
    df = _order_slots(spark, sf).withColumn("d", cal.local_date("ts")).where(cal.is_holiday(F.col("d")))
    return df.groupBy(F.date_format("d", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "spike_class",
    "zone:s ts:t spike_class:i is_spike:i",
    IMB
    + """SELECT zone, ts, CASE WHEN imbl_price > 1000 OR imbl_price < -500 THEN 2
    WHEN imbl_price > 200 OR imbl_price < -100 THEN 1 ELSE 0 END AS spike_class,
    CASE WHEN imbl_price > 200 OR imbl_price < -100 THEN 1 ELSE 0 END AS is_spike FROM imb""",
)
def spike_class(spark, sf):
    return A.imbalance(spark, sf).select(
        "zone", "ts", scalars.spike_class("imbl_price").alias("spike_class"),
        scalars.is_spike("imbl_price").alias("is_spike"),
    )


@query(
    "normal_class",
    "zone:s ts:t normal_class:i",
    IMB
    + """, n AS (SELECT * FROM imb WHERE imbl_price BETWEEN -100 AND 200),
    q AS (SELECT quantile_cont(imbl_price, 0.33) AS p33, quantile_cont(imbl_price, 0.67) AS p67 FROM n)
    SELECT zone, ts, CASE WHEN imbl_price < p33 THEN 0 WHEN imbl_price >= p67 THEN 2 ELSE 1 END
    AS normal_class FROM n, q""",
)
def normal_class(spark, sf):
    normal = A.imbalance(spark, sf).where(F.col("imbl_price").between(-100, 200))
    q = quantiles.exact_percentiles(normal, [], "imbl_price", {"p33": 0.33, "p67": 0.67})
    return attach(normal, q, []).select(
        "zone", "ts",
        scalars.normal_class("imbl_price", F.col("p33"), F.col("p67")).alias("normal_class"),
    )


@query(
    "regime_label",
    "zone:s ts:t regime:s",
    IMB
    + """SELECT zone, ts, CASE WHEN q >= 0.45 THEN 'extreme' WHEN q >= 0.15 THEN 'stress'
    WHEN direction < 0 AND imbl_price < -100 THEN 'deep_long' WHEN direction < 0 THEN 'normal_long'
    ELSE 'normal_short' END AS regime FROM (SELECT *, up_reg_price / 500 AS q FROM imb)""",
)
def regime_label(spark, sf):
    df = A.imbalance(spark, sf).withColumn("q", F.col("up_reg_price") / 500)
    return df.select("zone", "ts", scalars.regime("q", "direction", "imbl_price").alias("regime"))


@query(
    "direction_code",
    "event_id:i code:i from_number:i",
    """SELECT event_id, CASE event_type WHEN 'click' THEN -1 WHEN 'view' THEN 1 ELSE 0 END AS code,
    CAST(sign(value - 34) AS INTEGER) AS from_number FROM events""",
)
def direction_code(spark, sf):
    text = (
        F.when(F.col("event_type") == "click", "Long")
        .when(F.col("event_type") == "view", "SHORT")
        .when(F.col("event_type") == "error", "neutral")
        .otherwise(F.col("event_type"))
    )
    return A.events(spark, sf).select(
        "event_id", scalars.direction_code(text).alias("code"),
        scalars.direction_code((F.col("value") - 34).cast("string")).alias("from_number"),
    )


# --- matrices ------------------------------------------------------------------


def upsample_sql(name: str, source: str, cols: list[str], limit: int = 4) -> str:
    fills = ", ".join(
        f"last_value(s.{c} IGNORE NULLS) OVER (PARTITION BY g.zone ORDER BY g.ts ROWS {limit} PRECEDING) AS {c}"
        for c in cols
    )
    return f"""{name}_span AS (SELECT zone, min(ts) AS lo, max(ts) AS hi FROM {source} GROUP BY zone),
    {name}_grid AS (SELECT zone, unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS ts FROM {name}_span),
    {name} AS (SELECT g.zone, g.ts, {fills} FROM {name}_grid g LEFT JOIN {source} s
      ON g.zone = s.zone AND g.ts = s.ts)"""


WX = ["temperature", "windspeed_10m", "windspeed_100m", "solar_radiation", "cloudcover"]
WF = ["fcst_wind_100m", "fcst_wind_10m", "fcst_cloud_cover", "fcst_temperature"]
FLOW = [f"flow_{b.lower()}_mw" for b in A.BORDERS]

WIDE_FLOWS = """wfl AS (SELECT zone, ts, """ + ", ".join(
    f"max(flow_mw) FILTER (WHERE border = '{b}') AS flow_{b.lower()}_mw" for b in A.BORDERS
) + """ FROM fl GROUP BY zone, ts),
nfl AS (SELECT *, """ + " + ".join(f"coalesce({c}, 0)" for c in FLOW) + " AS net_position_mw FROM wfl)"

# Flows are filled three rows along their own hourly grid before they are joined.
FILLED_FLOWS = """ff_span AS (SELECT zone, min(ts) AS lo, max(ts) AS hi FROM nfl GROUP BY zone),
ff_grid AS (SELECT zone, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM ff_span),
ffl AS (SELECT g.zone, g.ts, """ + ", ".join(
    f"last_value(n.{c} IGNORE NULLS) OVER (PARTITION BY g.zone ORDER BY g.ts ROWS 3 PRECEDING) AS {c}"
    for c in [*FLOW, "net_position_mw"]
) + " FROM ff_grid g LEFT JOIN nfl n ON g.zone = n.zone AND g.ts = n.ts)"

MESAN = ["mesan_wind_speed", "mesan_temperature", "mesan_cloud_fraction", "mesan_wind_gust"]
LIVE = ["fcst_wind_10m", "fcst_temperature", "fcst_cloud_cover", "fcst_wind_gust", "fcst_precip_prob", "fcst_thunderstorm_prob"]
UNITS = ["nuclear_unavail_mw", "nuclear_unplanned_mw", "nuclear_outage_flag"]
GEN_FORECAST = ["wind_gen_forecast_mw", "solar_gen_forecast_mw"]

_BOTH = [c for c in WF if c in LIVE]  # the live forecast stands in where the first has none
MASTER = P.with_parts(
    P.EVENTS, P.IMBALANCE, P.DENSE_IMBALANCE, P.WEATHER, P.WEATHER_FORECAST, P.PRICES, P.FLOWS,
    WIDE_FLOWS, FILLED_FLOWS, P.ANALYSIS, P.LIVE_FORECAST, P.GENERATION_FORECAST, P.UNIT_OUTAGES,
    "spot AS (SELECT zone, ts, price_eur_mwh AS spot_price FROM pr)",
    upsample_sql("wx15", "wx", WX),
    upsample_sql("wf15", "wf", WF),
    upsample_sql("sp15", "spot", ["spot_price"]),
    upsample_sql("fl15", "ffl", [*FLOW, "net_position_mw"]),
    upsample_sql("an15", "an", MESAN),
    upsample_sql("lv15", "lv", LIVE),
    f"""lvn AS (SELECT zone, ts, {", ".join(f"{c} AS l_{c}" if c in _BOTH else c for c in LIVE)} FROM lv15),
    mf AS (SELECT * EXCLUDE ({", ".join([*_BOTH, *(f"l_{c}" for c in _BOTH)])}),
      {", ".join(f"coalesce({c}, l_{c}) AS {c}" for c in _BOTH)}
      FROM dimb LEFT JOIN wx15 USING (zone, ts) LEFT JOIN wf15 USING (zone, ts)
      LEFT JOIN sp15 USING (zone, ts) LEFT JOIN fl15 USING (zone, ts) LEFT JOIN an15 USING (zone, ts)
      LEFT JOIN lvn USING (zone, ts) LEFT JOIN gf USING (zone, ts) LEFT JOIN nu USING (zone, ts))""",
)


# The first four sources alone; the columns of the others are there and empty.
MASTER_FOUR = P.with_parts(
    P.EVENTS, P.IMBALANCE, P.DENSE_IMBALANCE, P.WEATHER, P.WEATHER_FORECAST, P.PRICES, P.FLOWS, WIDE_FLOWS, FILLED_FLOWS,
    "spot AS (SELECT zone, ts, price_eur_mwh AS spot_price FROM pr)",
    upsample_sql("wx15", "wx", WX),
    upsample_sql("wf15", "wf", WF),
    upsample_sql("sp15", "spot", ["spot_price"]),
    upsample_sql("fl15", "ffl", [*FLOW, "net_position_mw"]),
    f"""mf AS (SELECT *, {", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in [*MESAN, *GEN_FORECAST, *UNITS, *[c for c in LIVE if c not in WF]])}
      FROM dimb LEFT JOIN wx15 USING (zone, ts) LEFT JOIN wf15 USING (zone, ts)
      LEFT JOIN sp15 USING (zone, ts) LEFT JOIN fl15 USING (zone, ts))""",
)


def four_sources(spark, sf):
    return {
        "weather": A.weather(spark, sf),
        "weather_forecast": A.weather_forecast(spark, sf),
        "prices": A.prices(spark, sf),
        "flows": feeds.wide_flows(A.flows(spark, sf), A.BORDERS),
    }


def master_sources(spark, sf):
    return four_sources(spark, sf) | {
        "analysis": A.analysis(spark, sf),
        "generation_forecast": feeds.generation_forecast(A.generation_rows(spark, sf), "2024-01-01", "2024-01-31"),
        "nuclear": feeds.nuclear_outages(A.unit_outages(spark, sf), "2024-01-01", "2024-01-31"),
    }


def master_of(spark, sf):
    # Two of the sources lie on the quarter-hour grid already.
    return master.master_frame(
        A.imbalance(spark, sf), master_sources(spark, sf), limits={"generation_forecast": 0, "nuclear": 0},
        live=A.live_forecast(spark, sf),
    )


_OWN = ["imbl_price", "imbl_spot_diff", "up_reg_price", "down_reg_price"]


@query(
    "master_frame",
    "zone:s ts:t direction:i " + " ".join(f"{c}:d" for c in [*_OWN, "spot_price", "net_position_mw", *WX, *WF, *FLOW]),
    MASTER_FOUR + "SELECT * FROM mf",
)
def master_frame(spark, sf):
    return master.master_frame(A.imbalance(spark, sf), four_sources(spark, sf))


@query(
    "master_frame_all",
    "zone:s ts:t direction:i nuclear_outage_flag:i " + " ".join(
        f"{c}:d" for c in [
            *_OWN, "spot_price", "net_position_mw", *WX, *WF, *FLOW, *MESAN, *[c for c in LIVE if c not in WF], *GEN_FORECAST, *UNITS[:2],
        ]
    ),
    MASTER + "SELECT * FROM mf",
)
def master_frame_all(spark, sf):
    """All seven sources, with a second forecast where the first has nothing."""
    return master_of(spark, sf)


def _roll(c: str, n: int, fn: str, m: int | None = None) -> str:
    w = f"({BY} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({c}) OVER {w} >= {m or n} THEN {fn}({c}) OVER {w} END"


_LAGGED = {
    **{f"p{n}": ("imbl_price", n) for n in (1, 2, 4, 5, 8, 16, 17)}, **{f"d{n}": ("direction", n) for n in (1, 2, 4, 8)},
    "imbl_spot_diff_lag1": ("imbl_spot_diff", 1), "spot_price_lag1": ("spot_price", 1), "cloudcover_lag1": ("cloudcover", 1),
    **{f"{c}_lag1": (c, 1) for c in LIVE if c != "fcst_thunderstorm_prob"},
    "fcst_thunderstorm_lag1": ("fcst_thunderstorm_prob", 1), "mesan_wind_lag1": ("mesan_wind_speed", 1),
    "mesan_cloud_lag1": ("mesan_cloud_fraction", 1), "nuclear_unavail_lag1": ("nuclear_unavail_mw", 1),
    "unavail5": ("nuclear_unavail_mw", 5), "nuclear_unplanned_lag1": ("nuclear_unplanned_mw", 1),
    "nuclear_outage_flag_lag1": ("nuclear_outage_flag", 1), "wind_gen_forecast_lag4": ("wind_gen_forecast_mw", 4),
    "solar_gen_forecast_lag4": ("solar_gen_forecast_mw", 4), "gen96": ("wind_gen_forecast_mw", 96), "w96": ("windspeed_100m", 96),
    "w1": ("windspeed_100m", 1), "fw1": ("fcst_wind_100m", 1), "net_pos_lag4": ("net_position_mw", 4),
    **{f"{c}_lag4": (c, 4) for c in FLOW},
}
_CLASS = "CASE WHEN {0} > 1000 OR {0} < -500 THEN 2 WHEN {0} > 200 OR {0} < -100 THEN 1 ELSE 0 END".format("imbl_price")
# The exponential mean at a value: what the newest 150 values weigh (older ones: 1e-16).
_EWM_SQL = f"""
ew0 AS (SELECT zone, ts, rn, imbl_price AS x, rn - lag(rn) OVER ({BY}) AS gap FROM numbered WHERE imbl_price IS NOT NULL),
ew1 AS (SELECT *, CASE WHEN gap IS NULL THEN 0 ELSE pow(7 / 9.0, gap) / (pow(7 / 9.0, gap) + 2 / 9.0) END AS d FROM ew0),
ew2 AS (SELECT *, sum(CASE WHEN gap IS NULL THEN 0 ELSE ln(d) END) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS dd FROM ew1),
ew3 AS (SELECT *, list(struct_pack(g := (1 - d) * x, dd := dd)) OVER ({BY} ROWS 149 PRECEDING) AS l FROM ew2),
ew AS (SELECT zone, ts, list_sum(list_transform(l, lambda e: e.g * exp(dd - e.dd))) AS y FROM ew3)"""
_MATRIX_SQL = f""",
numbered AS (SELECT *, row_number() OVER ({BY}) AS rn FROM mf),{_EWM_SQL},
fe AS (SELECT m.*, last_value(y IGNORE NULLS) OVER (PARTITION BY m.zone ORDER BY m.ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS imbl_ewa
  FROM numbered m LEFT JOIN ew ON m.zone = ew.zone AND m.ts = ew.ts),
f0 AS (SELECT *, {", ".join(f"lag({c}, {n}) OVER w AS {name}" for name, (c, n) in _LAGGED.items())},
  lag(up_reg_price - down_reg_price, 1) OVER w AS reg_spread, lead(imbl_price, 1) OVER w AS target_price,
  lead({_CLASS}, 1) OVER w AS target_class, {_CLASS} AS spike_class, {_roll('windspeed_100m', 672, 'avg', 48)} AS wind_7d_mean
  FROM fe WINDOW w AS ({BY})),
f1 AS (SELECT *, CASE WHEN d1 = d2 THEN 0 ELSE 1 END AS flip, CASE WHEN abs(p1) > 200 THEN 1 ELSE 0 END AS s,
  {", ".join(f"{_roll('p1', n, fn)} AS {name}{n}" for n in (4, 16) for fn, name in (('avg', 'm'), ('stddev_samp', 's'), ('max', 'hi'), ('min', 'lo')))},
  {_roll('p1', 96, 'avg')} AS imbl_roll_1d_mean,
  {_roll('reg_spread', 4, 'avg')} AS reg_spread_roll_1h, {_roll('reg_spread', 16, 'avg')} AS reg_spread_roll_4h,
  {_roll('net_pos_lag4', 96, 'avg', 12)} AS net_pos_roll1d FROM f0),
f2 AS (SELECT *, lag(s4) OVER ({BY}) AS s4_lag,
  CASE WHEN s = lag(s) OVER ({BY}) THEN 0 ELSE 1 END AS schg,
  {", ".join(f"CASE WHEN rn >= {n} THEN sum(flip) OVER ({BY} ROWS {n - 1} PRECEDING) END AS dir_flip_rate_{name}" for name, n in (('1h', 4), ('4h', 16), ('1d', 96)))},
  max(CASE WHEN flip = 1 THEN rn END) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS flip_at,
  max(CASE WHEN s = 1 THEN rn END) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS stress_at FROM f1),
f3 AS (SELECT *, max(CASE WHEN schg = 1 THEN rn END) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS schg_at FROM f2),
{calendar_sql('f3', 96)},
g0 AS (SELECT *, greatest(15 - temperature, 0) AS heating0, CASE WHEN 200 - p1 > 200 THEN 200 ELSE 200 - p1 END AS stress_proximity_up,
  CASE WHEN p1 + 100 > 100 THEN 100 ELSE p1 + 100 END AS stress_proximity_down, windspeed_100m - wind_7d_mean AS wind_surprise,
  rn - flip_at + 1 AS dir_streak FROM cal)
SELECT *, {", ".join(f"p{n} AS imbl_lag_{n}" for n in (1, 2, 4, 8, 16))}, p4 AS imbl_lag_1h, p8 AS imbl_lag_2h, p16 AS imbl_lag_4h,
  d1 AS dir_lag_1, d2 AS dir_lag_2, d4 AS dir_lag_4, d8 AS dir_lag_8, abs(p1) AS imbl_abs_lag1,
  {", ".join(f"m{n} AS imbl_roll_{h}_mean, s{n} AS imbl_roll_{h}_std, hi{n} AS imbl_roll_{h}_max, lo{n} AS imbl_roll_{h}_min, (p1 - m{n}) / (s{n} + 1e-6) AS price_zscore_{h}" for n, h in ((4, '1h'), (16, '4h')))},
  (rn - schg_at) * s AS consecutive_stress, rn - coalesce(stress_at, 0) AS periods_since_stress,
  s4 - s16 AS vol_acceleration, p1 - p5 AS price_momentum_1h, p1 - p17 AS price_momentum_4h,
  reg_spread_roll_1h - reg_spread_roll_4h AS reg_spread_accel,
  CASE WHEN d1 = 1 AND d2 = -1 THEN 1 ELSE 0 END AS regime_flip_to_short, CASE WHEN d1 = -1 AND d2 = 1 THEN 1 ELSE 0 END AS regime_flip_to_long,
  CASE WHEN target_class > 0 THEN 1 WHEN target_class = 0 THEN 0 END AS target_binary, CASE WHEN spike_class > 0 THEN 1 ELSE 0 END AS is_spike,
  CASE WHEN temperature IS NOT NULL THEN heating0 END AS heating_degree, temperature * is_peak AS temp_x_peak, temperature * is_winter AS temp_x_winter,
  CASE WHEN temperature IS NOT NULL THEN heating0 END * is_peak * is_winter AS demand_stress,
  CASE WHEN temperature IS NOT NULL THEN heating0 END * is_peak * is_winter * s4_lag AS demand_stress_x_vol,
  dir_streak * (CASE WHEN d1 = 1 THEN 1 ELSE 0 END) * is_peak AS short_streak_x_peak,
  windspeed_100m * is_night AS wind_x_night, windspeed_100m * is_peak AS wind_x_peak, windspeed_100m * windspeed_100m AS wind_squared,
  wind_surprise * (200 / nullif(stress_proximity_up + 1, 0)) AS wind_surprise_x_stress, w1 - fw1 AS wind_forecast_surprise,
  nuclear_unavail_lag1 - unavail5 AS nuclear_sudden_drop, nuclear_unavail_lag1 * is_peak AS nuclear_x_peak,
  nuclear_unavail_lag1 * is_winter AS nuclear_x_winter,
  nuclear_unavail_lag1 * (200 / nullif(stress_proximity_up + 1, 0)) AS nuclear_x_stress_proximity, w96 - gen96 AS wind_forecast_vs_actual,
  {", ".join(wave_sql(v, p, n + "_{}") for v, p, n in (("hour", 24, "hour"), ("dayofweek", 7, "dow"), ("month", 12, "month"), ("slot", 96, "slot")))},
  {", ".join(wave_sql(v, n, p + "_{}_k" + str(k), k) for p, v, n, k in _HARMONICS)}
FROM g0"""


@query(
    "imbalance_feature_matrix",
    "zone:s ts:t imbl_lag_1:d imbl_lag_4h:d imbl_roll_1h_mean:d imbl_roll_1h_std:d imbl_roll_4h_max:d "
    "imbl_roll_1d_mean:d price_zscore_1h:d stress_proximity_up:d stress_proximity_down:d "
    "consecutive_stress:i periods_since_stress:i dir_streak:i dir_flip_rate_1d:i price_momentum_4h:d "
    "reg_spread:d reg_spread_roll_4h:d wind_7d_mean:d wind_surprise:d heating_degree:d "
    "demand_stress_x_vol:d short_streak_x_peak:i wind_forecast_surprise:d fcst_temperature_lag1:d "
    "flow_se4_mw_lag4:d net_pos_lag4:d net_pos_roll1d:d slot:i is_holiday:i season:i "
    "target_price:d target_class:i",
    MASTER_FOUR + _MATRIX_SQL,
)
def imbalance_feature_matrix(spark, sf):
    return imbalance_features(master.master_frame(A.imbalance(spark, sf), four_sources(spark, sf)))


_WHOLE = {
    *[f"dir_lag_{n}" for n in (1, 2, 4, 8)], "dir_streak", "consecutive_stress", "periods_since_stress", "short_streak_x_peak",
    *[f"dir_flip_rate_{h}" for h in ("1h", "4h", "1d")], "regime_flip_to_short", "regime_flip_to_long", "nuclear_outage_flag_lag1",
    "season", "is_night", "is_peak", "is_weekend", "is_holiday", "is_winter", "target_binary", "target_class", "spike_class", "is_spike",
}


def _typed(names) -> str:
    return "zone:s ts:t " + " ".join(f"{c}:{'i' if c in _WHOLE else 'd'}" for c in dict.fromkeys(names))


@query(
    "imbalance_price_features",
    _typed([*fi.BASE, *fi.SPIKE, "target_price", "target_binary", "target_class", "spike_class", "is_spike"]),
    MASTER + _MATRIX_SQL,
)
def imbalance_price_features(spark, sf):
    """Every feature made of prices and directions, and the targets."""
    return imbalance_features(master_of(spark, sf))


@query(
    "imbalance_context_features",
    _typed([
        *fi.CALENDAR, *fi.WEATHER, *fi.FORECAST, *fi.NUCLEAR, *fi.GENERATION, *[f"{c}_lag4" for c in FLOW], "net_pos_lag4", "net_pos_roll1d",
    ]),
    MASTER + _MATRIX_SQL,
)
def imbalance_context_features(spark, sf):
    """Every feature of the calendar, weather, forecasts, outages, generation and flows."""
    return imbalance_features(master_of(spark, sf))


def spot_frame_of(spark, sf, imbalance: bool = True):
    return master.spot_frame(
        A.prices(spark, sf), A.weather(spark, sf), A.generation(spark, sf),
        A.nuclear_gen(spark, sf), feeds.wide_flows(A.flows(spark, sf), A.BORDERS),
        A.imbalance(spark, sf) if imbalance else None,
        [A.weather_forecast(spark, sf)],
    )


def _fill3(name: str, source: str, cols: list[str]) -> str:
    fills = ", ".join(
        f"last_value(s.{c} IGNORE NULLS) OVER (PARTITION BY b.zone ORDER BY b.ts ROWS 3 PRECEDING) AS {c}"
        for c in cols
    )
    return f"{name} AS (SELECT b.zone, b.ts, {fills} FROM base b LEFT JOIN {source} s ON b.zone = s.zone AND b.ts = s.ts)"


SPOT = P.with_parts(
    P.EVENTS, P.IMBALANCE, P.WEATHER, P.WEATHER_FORECAST, P.PRICES, P.GENERATION, P.NUCLEAR, P.FLOWS,
    WIDE_FLOWS, FILLED_FLOWS,
    """pw AS (SELECT * FROM pr JOIN wx USING (zone, ts)),
    pw_span AS (SELECT zone, min(ts) AS lo, max(ts) AS hi FROM pw GROUP BY zone),
    pw_grid AS (SELECT zone, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM pw_span),
    base AS (SELECT * FROM pw_grid LEFT JOIN pw USING (zone, ts) LEFT JOIN gen USING (zone, ts))""",
    _fill3("nucf", "nuc", ["nuclear_gen_mw"]),
    _fill3("flf", "ffl", [*FLOW, "net_position_mw"]),
    """himb AS (SELECT zone, date_trunc('hour', ts) AS ts, avg(imbl_price) AS imbl_price,
      avg(direction) AS direction, avg(up_reg_price) AS up_reg_price, avg(down_reg_price) AS down_reg_price
      FROM imb GROUP BY ALL),
    sf AS (SELECT * FROM base LEFT JOIN nucf USING (zone, ts) LEFT JOIN flf USING (zone, ts)
      LEFT JOIN himb USING (zone, ts) LEFT JOIN wf USING (zone, ts))""",
)

SPOT_COLUMNS = (
    "zone:s ts:t price_eur_mwh:d wind_gen_mw:d load_mw:d nuclear_gen_mw:d net_position_mw:d "
    "imbl_price:d direction:d fcst_wind_100m:d temperature:d"
)


@query("spot_frame", SPOT_COLUMNS, SPOT + "SELECT * FROM sf")
def spot_frame(spark, sf):
    return spot_frame_of(spark, sf)


@query(
    "spot_feature_matrix",
    "zone:s ts:t price_lag_24h:d price_lag_168h:d price_ewa:d price_3d_mean:d price_roll_168h_mean:d "
    "price_roll_168h_std:d lag24_x_hour_sin:d heating_degree:d wind_7d_mean:d wind_surprise:d "
    "wind_x_weekend:d fcst_wind_surprise:d wind_gen_lag24:d wind_load_ratio:d load_residual:d "
    "nuclear_gen_lag24:d nuclear_shortfall:d nuclear_ramp_24h:d flow_no1_mw_lag168:d net_pos_roll7d:d "
    "se4_x_peak:d imbl_price_lag24:d imbl_roll_24h_std:d imbl_spike_flag_lag24:i imbl_spread_lag24:d",
    SPOT
    + f""",
s0 AS (SELECT *, row_number() OVER w AS rn, lag(price_eur_mwh, 24) OVER w AS price_lag_24h,
  lag(price_eur_mwh, 168) OVER w AS price_lag_168h,
  {' + '.join(f'lag(price_eur_mwh, {n}) OVER w * {x}' for n, x in ANCHOR_WEIGHTS.items())} AS price_ewa,
  (lag(price_eur_mwh, 24) OVER w + lag(price_eur_mwh, 48) OVER w + lag(price_eur_mwh, 72) OVER w) / 3
    AS price_3d_mean,
  ({' + '.join(f'lag(windspeed_100m, {n}) OVER w' for n in ANCHOR_WEIGHTS)}) / 7 AS wind_7d_mean,
  lag(wind_gen_mw, 24) OVER w AS wind_gen_lag24, lag(load_mw, 24) OVER w AS load_lag24,
  lag(nuclear_gen_mw, 24) OVER w AS nuclear_gen_lag24,
  lag(nuclear_gen_mw, 24) OVER w - lag(nuclear_gen_mw, 48) OVER w AS nuclear_ramp_24h,
  lag(flow_no1_mw, 168) OVER w AS flow_no1_mw_lag168, lag(flow_se4_mw, 24) OVER w AS se4_lag24,
  lag(net_position_mw, 24) OVER w AS net_lag24, lag(imbl_price, 24) OVER w AS imbl_price_lag24,
  lag(CASE WHEN abs(imbl_price) > 200 THEN 1 ELSE 0 END, 24) OVER w AS imbl_spike_flag_lag24,
  lag(up_reg_price - down_reg_price, 24) OVER w AS imbl_spread_lag24
  FROM sf WINDOW w AS ({BY})),
s1 AS (SELECT *, {_roll('price_lag_24h', 168, 'avg')} AS price_roll_168h_mean,
  {_roll('price_lag_24h', 168, 'stddev_samp')} AS price_roll_168h_std,
  {_roll('nuclear_gen_lag24', 168, 'max')} - nuclear_gen_lag24 AS nuclear_shortfall,
  {_roll('net_lag24', 168, 'avg')} AS net_pos_roll7d,
  {_roll('imbl_price_lag24', 24, 'stddev_samp')} AS imbl_roll_24h_std FROM s0),
{calendar_sql('s1', 24)}
SELECT *, price_lag_24h * sin(CAST(hour AS DOUBLE) * {2 * math.pi!r} / 24.0) AS lag24_x_hour_sin,
  CASE WHEN 15 - temperature < 0 THEN 0 ELSE 15 - temperature END AS heating_degree,
  windspeed_100m - wind_7d_mean AS wind_surprise, windspeed_100m * is_weekend AS wind_x_weekend,
  windspeed_100m - fcst_wind_100m AS fcst_wind_surprise,
  wind_gen_lag24 / (load_lag24 + 1) AS wind_load_ratio,
  CASE WHEN load_lag24 - wind_gen_lag24 < 0 THEN 0 ELSE load_lag24 - wind_gen_lag24 END AS load_residual,
  se4_lag24 * is_peak AS se4_x_peak FROM cal""",
)
def spot_feature_matrix(spark, sf):
    return spot_features(spot_frame_of(spark, sf))


@query(
    "spot_anchor_features",
    "zone:s ts:t price_same_hour_3d_mean:d price_same_hour_7d_mean:d price_lag24_vs_hour_mean:d "
    "nuclear_cap_lag24:d nuclear_cap_shortfall:d",
    SPOT
    + f""", a AS (SELECT *, lag(price_eur_mwh, 24) OVER w AS p24,
  (lag(price_eur_mwh, 24) OVER w + lag(price_eur_mwh, 48) OVER w + lag(price_eur_mwh, 72) OVER w) / 3
    AS price_same_hour_3d_mean,
  ({' + '.join(f'lag(price_eur_mwh, {n}) OVER w' for n in ANCHOR_WEIGHTS)}) / 7 AS price_same_hour_7d_mean,
  lag(nuclear_cap_mw, 24) OVER w AS nuclear_cap_lag24, lag(nuclear_cap_mw, 25) OVER w AS cap25
  FROM sf WINDOW w AS ({BY}))
  SELECT *, p24 - price_same_hour_7d_mean AS price_lag24_vs_hour_mean,
  {_roll('cap25', 168, 'max')} - nuclear_cap_lag24 AS nuclear_cap_shortfall FROM a""",
)
def spot_anchor_features(spark, sf):
    return spot_features(spot_frame_of(spark, sf), anchors=True)


# --- every column of the spot matrix ---------------------------------------------

SMHI = ["smhi_wind_speed_ms", "smhi_wind_gust_ms", "smhi_cloud_fraction", "smhi_temperature_c", "smhi_precip_prob"]
_SPOT_LAGS = {
    **{f"price_lag_{n}h": ("price_eur_mwh", n) for n in (24, 48, 168)},
    "wind_gen_lag24": ("wind_gen_mw", 24), "load_lag24": ("load_mw", 24), "nuclear_gen_lag24": ("nuclear_gen_mw", 24),
    "nuclear48": ("nuclear_gen_mw", 48), **{f"{c}_lag{n}": (c, n) for c in FLOW for n in (24, 168)},
    "net_pos_lag24": ("net_position_mw", 24), "imbl_price_lag24": ("imbl_price", 24), "imbl_price_lag168": ("imbl_price", 168),
    "imbl_direction_lag24": ("direction", 24),
}
_HOURLY_HARMONICS = [(p, v, n, k) for p, v, n, top in (
    ("daily", "slot", 24, 3), ("weekly", "how", 168, 3), ("annual", "hoy", 8760, 2)
) for k in range(1, top + 1)]
_SPOT_TIMES = {"night": "is_night", "peak": "is_peak", "weekend": "is_weekend", "winter": "CAST(season = 1 AS INT)", "summer": "CAST(season = 3 AS INT)"}
_SPOT_SQL = SPOT + f""", {P.LOCATION_FORECAST}, sj AS (SELECT * FROM sf LEFT JOIN lf USING (zone, ts)),
a0 AS (SELECT *, {", ".join(f"lag({c}, {n}) OVER w AS {name}" for name, (c, n) in _SPOT_LAGS.items())},
  {' + '.join(f'lag(price_eur_mwh, {n}) OVER w * {x}' for n, x in ANCHOR_WEIGHTS.items())} AS price_ewa,
  (lag(price_eur_mwh, 24) OVER w + lag(price_eur_mwh, 48) OVER w + lag(price_eur_mwh, 72) OVER w) / 3 AS price_3d_mean,
  ({' + '.join(f'lag(windspeed_100m, {n}) OVER w' for n in fs.WEEK_LAGS)}) / 7 AS wind_7d_mean,
  lag(CASE WHEN abs(imbl_price) > 200 THEN 1 ELSE 0 END, 24) OVER w AS imbl_spike_flag_lag24,
  lag(up_reg_price - down_reg_price, 24) OVER w AS imbl_spread_lag24 FROM sj WINDOW w AS ({BY})),
a1 AS (SELECT *, {_roll('price_lag_24h', 168, 'avg')} AS price_roll_168h_mean, {_roll('price_lag_24h', 168, 'stddev_samp')} AS price_roll_168h_std,
  {_roll('price_lag_24h', 720, 'avg')} AS price_roll_720h_mean, {_roll('nuclear_gen_lag24', 168, 'max')} - nuclear_gen_lag24 AS nuclear_shortfall,
  {_roll('net_pos_lag24', 168, 'avg')} AS net_pos_roll7d, {_roll('imbl_price_lag24', 24, 'avg')} AS imbl_roll_24h_mean,
  {_roll('imbl_price_lag24', 24, 'stddev_samp')} AS imbl_roll_24h_std, windspeed_100m - wind_7d_mean AS wind_surprise FROM a0),
{calendar_sql('a1', 24)},
a2 AS (SELECT *, {wave_sql("hour", 24, "hour_{}")}, {wave_sql("month", 12, "month_{}")}, {wave_sql("dayofweek", 7, "dow_{}")},
  {", ".join(wave_sql(v, n, p + "_{}_k" + str(k), k) for p, v, n, k in _HOURLY_HARMONICS)} FROM cal)
SELECT *, price_lag_24h - price_ewa AS price_lag24_vs_ewa, price_lag_24h - price_3d_mean AS price_lag24_vs_3d,
  price_roll_720h_mean * price_roll_168h_std AS regime_x_vol, price_lag_24h * hour_sin AS lag24_x_hour_sin,
  price_lag_24h * hour_cos AS lag24_x_hour_cos,
  CASE WHEN 15 - temperature < 0 THEN 0 ELSE 15 - temperature END AS heating_degree, cloudcover * solar_radiation AS cloud_x_solar,
  wind_surprise * is_night AS wind_surprise_x_night, wind_surprise * price_ewa AS wind_vs_ewa,
  {", ".join(f"windspeed_100m * {x} AS wind_x_{n}" for n, x in _SPOT_TIMES.items())}, windspeed_100m * windspeed_100m AS wind_squared,
  {", ".join(f"temperature * {x} AS temp_x_{n}" for n, x in _SPOT_TIMES.items() if n in ("night", "peak", "winter"))},
  windspeed_100m - fcst_wind_100m AS fcst_wind_surprise, cloudcover - fcst_cloud_cover AS fcst_cloud_surprise,
  smhi_wind_speed_ms - windspeed_100m AS smhi_wind_surprise, wind_gen_lag24 / nullif(load_lag24 + 1, 0) AS wind_load_ratio,
  wind_gen_lag24 * is_night AS wind_gen_x_night, wind_gen_lag24 * is_weekend AS wind_gen_x_weekend,
  CASE WHEN load_lag24 - wind_gen_lag24 < 0 THEN 0 ELSE load_lag24 - wind_gen_lag24 END AS load_residual,
  nuclear_gen_lag24 - nuclear48 AS nuclear_ramp_24h, nuclear_gen_lag24 * is_peak AS nuclear_x_peak,
  flow_se4_mw_lag24 * is_peak AS se4_x_peak FROM a2"""
_SPOT_WHOLE = {"season", "is_night", "is_peak", "is_weekend", "is_holiday", "imbl_spike_flag_lag24"}
_SPOT_ALL = [
    "price_lag_24h", *fs.PRICE, *fs.CALENDAR, "temperature", "windspeed_100m", "cloudcover", "heating_degree", "wind_7d_mean", "wind_surprise",
    "wind_surprise_x_night", "wind_vs_ewa", *[f"wind_x_{n}" for n in _SPOT_TIMES], "wind_squared", "temp_x_night", "temp_x_peak",
    "temp_x_winter", "cloud_x_solar", *WF, "fcst_wind_surprise", "fcst_cloud_surprise", *SMHI, "smhi_wind_surprise", *fs.GENERATION,
    "nuclear_gen_lag24", "nuclear_ramp_24h", "nuclear_shortfall", "nuclear_x_peak",
    *[f"{c}_lag{n}" for c in FLOW for n in (24, 168)], "net_pos_lag24", "net_pos_roll7d", "se4_x_peak", *fs.IMBALANCE,
]


@query(
    "spot_feature_columns",
    "zone:s ts:t " + " ".join(f"{c}:{'i' if c in _SPOT_WHOLE else 'd'}" for c in _SPOT_ALL),
    _SPOT_SQL,
)
def spot_feature_columns(spark, sf):
    """Every column of the spot matrix, the point forecast among them."""
    frame = spot_frame_of(spark, sf).join(A.location_forecast(spark, sf), ["zone", "ts"], "left")
    return spot_features(frame)


_MODES = {
    "regression": [*fi.BASE, *fi.CALENDAR, *fi.WEATHER, *fi.INTERACTIONS, *fi.REGULATION, *fi.FORECAST, *fi.NUCLEAR, *fi.GENERATION],
    "spike": [*fi.BASE, *fi.SPIKE, *fi.CALENDAR, *fi.WEATHER, *fi.FORECAST, *fi.NUCLEAR, *fi.GENERATION],
}
_MODES = {m: list(dict.fromkeys([*cs, *[f"{f}_lag4" for f in FLOW], "net_pos_lag4", "net_pos_roll1d"])) for m, cs in _MODES.items()}
_NAMED = list(dict.fromkeys(c for cs in _MODES.values() for c in cs))


@query(
    "feature_names",
    "mode:s position:i feature:s",
    f"""WITH m AS ({MASTER + _MATRIX_SQL}),
    k AS (SELECT unnest([{", ".join(f"'{c}'" for c in _NAMED)}]) AS feature, unnest([{", ".join(f"count({c})" for c in _NAMED)}]) AS n FROM m),
    w AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {i}, '{c}')" for m, cs in _MODES.items() for i, c in enumerate(cs))}) t(mode, i, feature))
    SELECT mode, row_number() OVER (PARTITION BY mode ORDER BY i) - 1 AS position, feature FROM w JOIN k USING (feature) WHERE n > 0""",
)
def feature_names(spark, sf):
    """The ordered features of two modes that hold values in the matrix of all sources."""
    feats = imbalance_features(master_of(spark, sf))
    names = {m: fi.feature_list(feats.columns, m) for m in ("regression", "spike")}
    known = projections.known_columns(feats, sorted({c for cs in names.values() for c in cs}))
    rows = [(m, i, c) for m in names for i, c in enumerate(fi.feature_list(feats.columns, m, known))]
    return spark.createDataFrame(rows, "mode string, position int, feature string")
