"""SQL twins of ``plans.adapters`` as named CTEs, joined in front of an oracle body."""

from __future__ import annotations

EVENTS = """ev AS (
  SELECT 'Z' || CAST(user_id % 4 AS VARCHAR) AS zone, ts, event_type, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, user_id, event_id
  FROM events)"""

IMBALANCE = """imb AS (
  SELECT zone, time_bucket(INTERVAL 15 MINUTE, ts) AS ts,
         avg(value) * 2.0 - 105.0 AS imbl_price,
         CAST(sign(count(*) FILTER (WHERE event_type = 'click')
              - count(*) FILTER (WHERE event_type = 'view')) AS INTEGER) AS direction,
         avg(value) - 34.0 AS imbl_spot_diff,
         max(value) AS up_reg_price, min(value) AS down_reg_price
  FROM ev GROUP BY ALL)"""

DENSE_IMBALANCE = """imb_span AS (SELECT zone, min(ts) AS lo, max(ts) AS hi FROM imb GROUP BY zone),
imb_grid AS (
  SELECT zone, unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS ts FROM imb_span),
dimb AS (
  SELECT g.zone, g.ts, i.* EXCLUDE (zone, ts)
  FROM imb_grid g LEFT JOIN imb i ON g.zone = i.zone AND g.ts = i.ts)"""

WEATHER = """wx AS (
  SELECT zone, time_bucket(INTERVAL 1 HOUR, ts) AS ts,
         avg(k) / 4 - 8 AS temperature, avg(k) / 10 AS windspeed_10m,
         max(k) / 6 AS windspeed_100m, min(k) AS solar_radiation, avg(k) AS cloudcover
  FROM ev GROUP BY ALL)"""

WEATHER_FORECAST = """wf AS (
  SELECT zone, time_bucket(INTERVAL 1 HOUR, ts) AS ts,
         max(k) / 6 AS fcst_wind_100m, avg(k) / 10 AS fcst_wind_10m,
         avg(k) AS fcst_cloud_cover, avg(k) / 4 - 8 AS fcst_temperature
  FROM ev WHERE event_type <> 'error' GROUP BY ALL)"""

PRICES = """pr AS (
  SELECT zone, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(value) AS price_eur_mwh
  FROM ev GROUP BY ALL)"""

DENSE_PRICES = """pr_span AS (SELECT zone, min(ts) AS lo, max(ts) AS hi FROM pr GROUP BY zone),
pr_grid AS (
  SELECT zone, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM pr_span),
dpr AS (
  SELECT g.zone, g.ts, p.price_eur_mwh
  FROM pr_grid g LEFT JOIN pr p ON g.zone = p.zone AND g.ts = p.ts)"""

GENERATION = """gen AS (
  SELECT zone, time_bucket(INTERVAL 1 HOUR, ts) AS ts,
         sum(value) FILTER (WHERE event_type = 'click') AS wind_gen_mw,
         max(value) AS nuclear_cap_mw, sum(value) AS load_mw
  FROM ev GROUP BY ALL)"""

NUCLEAR = """nuc AS (
  SELECT zone, time_bucket(INTERVAL 1 HOUR, ts) AS ts, sum(k) AS nuclear_gen_mw
  FROM ev WHERE event_type IN ('view', 'purchase', 'error') GROUP BY ALL)"""

FLOWS = """side AS (
  SELECT zone, time_bucket(INTERVAL 1 HOUR, ts) AS ts,
         ['SE4', 'NO1', 'DK1', 'SE2'][CAST((user_id // 4) % 4 + 1 AS INTEGER)] AS border,
         event_type, sum(value) AS flow_mw
  FROM ev WHERE event_type IN ('purchase', 'signup') GROUP BY ALL),
fl AS (
  SELECT coalesce(e.zone, i.zone) AS zone, coalesce(e.ts, i.ts) AS ts,
         coalesce(e.border, i.border) AS border,
         coalesce(e.flow_mw, 0) - coalesce(i.flow_mw, 0) AS flow_mw
  FROM (SELECT * FROM side WHERE event_type = 'purchase') e
  FULL JOIN (SELECT * FROM side WHERE event_type = 'signup') i
    ON e.zone = i.zone AND e.ts = i.ts AND e.border = i.border)"""

ANALYSIS = """an AS (
  SELECT zone, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(k) / 9 AS mesan_wind_speed,
         min(k) / 5 - 6 AS mesan_temperature, max(k) / 100 AS mesan_cloud_fraction, max(k) / 4 AS mesan_wind_gust
  FROM ev WHERE event_type IN ('click', 'signup', 'error') GROUP BY ALL)"""

LIVE_FORECAST = """lv AS (
  SELECT zone, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(k) / 11 AS fcst_wind_10m,
         max(k) / 4 - 8 AS fcst_temperature, min(k) AS fcst_cloud_cover, max(k) / 3 AS fcst_wind_gust,
         avg(k) / 100 AS fcst_precip_prob, min(k) / 100 AS fcst_thunderstorm_prob
  FROM ev WHERE event_type <> 'view' GROUP BY ALL)"""

LOCATION_FORECAST = """lf AS (
  SELECT zone, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(k) / 8 AS smhi_wind_speed_ms, max(k) / 5 AS smhi_wind_gust_ms,
         avg(k) AS smhi_cloud_fraction, min(k) / 4 - 8 AS smhi_temperature_c, avg(k) / 100 AS smhi_precip_prob
  FROM ev WHERE event_type <> 'purchase' GROUP BY ALL)"""

# The wind and solar forecast on the quarter-hour grid of January, filled 4 slots.
GENERATION_FORECAST = """gr AS (
  SELECT zone, time_bucket(INTERVAL 1 HOUR, ts) AS ts,
         sum(value) FILTER (WHERE event_type = 'purchase') AS wind, sum(value) FILTER (WHERE event_type = 'signup') AS solar
  FROM ev GROUP BY ALL),
gf_grid AS (
  SELECT zone, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 15 MINUTE)) AS ts
  FROM (SELECT DISTINCT zone FROM gr)),
gf AS (
  SELECT g.zone, g.ts,
    last_value(wind IGNORE NULLS) OVER (PARTITION BY g.zone ORDER BY g.ts ROWS 4 PRECEDING) AS wind_gen_forecast_mw,
    last_value(solar IGNORE NULLS) OVER (PARTITION BY g.zone ORDER BY g.ts ROWS 4 PRECEDING) AS solar_gen_forecast_mw
  FROM gf_grid g LEFT JOIN gr ON g.zone = gr.zone AND g.ts = gr.ts)"""

# Power offline per quarter hour of January by the newest revision of each nuclear report.
UNIT_OUTAGES = """un AS (
  SELECT zone, user_id AS mrid, event_id % 2 AS revision, event_id % 3 AS kind, greatest(value - 20.0, 0) AS mw,
         ts AS a, ts + to_hours(CAST(event_id % 9 + 1 AS INTEGER)) AS b
  FROM ev WHERE event_type = 'error' AND user_id % 5 <> 0
  QUALIFY revision = max(revision) OVER (PARTITION BY mrid)),
un_slots AS (
  SELECT zone, mw, kind, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, a + INTERVAL 15 MINUTE - INTERVAL 1 MICROSECOND),
    b - INTERVAL 1 MICROSECOND, INTERVAL 15 MINUTE)) AS ts FROM un),
un_sums AS (
  SELECT zone, ts, sum(mw) AS mw, sum(CASE WHEN kind <> 1 THEN mw ELSE 0 END) AS unplanned FROM un_slots GROUP BY ALL),
nu AS (
  SELECT g.zone, g.ts, coalesce(mw, 0) AS nuclear_unavail_mw, coalesce(unplanned, 0) AS nuclear_unplanned_mw,
         CASE WHEN unplanned > 0 THEN 1 ELSE 0 END AS nuclear_outage_flag
  FROM (SELECT zone, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 15 MINUTE)) AS ts
    FROM (SELECT DISTINCT zone FROM un)) g LEFT JOIN un_sums u ON g.zone = u.zone AND g.ts = u.ts)"""

RUNS = """runs AS (
  SELECT zone, ts + INTERVAL 24 HOUR AS ts,
         date_trunc('day', ts + INTERVAL 24 HOUR) AS generated_at, price_eur_mwh AS p50
  FROM pr
  UNION ALL
  SELECT zone, ts + INTERVAL 48 HOUR AS ts,
         date_trunc('day', ts + INTERVAL 48 HOUR) - INTERVAL 12 HOUR, price_eur_mwh
  FROM pr),
fc AS (
  SELECT zone, ts, CAST(generated_at AS TIMESTAMP) AS generated_at,
         p50 - 30 AS p05, p50, p50 + 30 AS p95, p50 / 200 AS spike_proba
  FROM runs)"""

SCORED = """lagged AS (
  SELECT *, lag(price_eur_mwh) OVER (PARTITION BY zone ORDER BY ts) AS lag1 FROM dpr),
best AS (
  SELECT * FROM fc WHERE generated_at <= ts
  QUALIFY row_number() OVER (PARTITION BY zone, ts ORDER BY generated_at DESC) = 1),
sc AS (
  SELECT l.zone, l.ts, l.price_eur_mwh AS y, b.p05, b.p50, b.p95, l.lag1,
         least(b.spike_proba, 1.0) AS spike_proba,
         CAST(l.price_eur_mwh > 60 AS INTEGER) AS y_spike
  FROM lagged l JOIN best b ON l.zone = b.zone AND l.ts = b.ts
  WHERE l.price_eur_mwh IS NOT NULL)"""

OUTAGES = """outg AS (
  SELECT 'Z' || CAST(o_custkey % 4 AS VARCHAR) AS zone, o_orderkey // 2 AS mrid,
         CAST(o_orderkey % 2 AS INTEGER) AS revision,
         CASE o_orderkey % 3 WHEN 0 THEN 'Nuclear' WHEN 1 THEN 'nuclear unit' ELSE 'Hydro' END AS plant_type,
         CASE WHEN o_orderpriority LIKE '1%' THEN 'Unplanned outage'
              WHEN o_orderpriority LIKE '5%' THEN NULL ELSE 'Planned maintenance' END AS businesstype,
         o_totalprice / 1000 AS nominal_power, 50.0 AS avail_qty,
         o_orderdate AS start,
         o_orderdate + to_hours(CAST(o_orderkey % 70 + 1 AS INTEGER)) AS "end"
  FROM orders)"""

LOCAL = "timezone('Europe/Stockholm', timezone('UTC', {}))"


def local(ts: str) -> str:
    """Naive Stockholm time of a naive UTC time."""
    return LOCAL.format(ts)


def with_parts(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
