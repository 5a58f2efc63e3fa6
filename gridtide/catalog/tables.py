"""Registered queries over sources, table maintenance, joins and projections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.catalog import sql_parts as P
from gridtide.catalog.align import BY, DPR, IMB, PR
from gridtide.catalog.core import query
from gridtide.catalog.features import FILLED_FLOWS, FLOW, WF, WIDE_FLOWS, WX
from gridtide.operators import grid, joins, projections
from gridtide.operators.blocks import HOURLY, QUARTER
from gridtide.plans import adapters as A
from gridtide.plans import evaluate, master
from gridtide.schemas import SCHEMAS
from gridtide.session import scratch_path
from gridtide.sources import feeds, tables

WXQ = P.with_parts(P.EVENTS, P.WEATHER)
FLQ = P.with_parts(P.EVENTS, P.FLOWS)
FCQ = P.with_parts(P.EVENTS, P.PRICES, P.DENSE_PRICES, P.RUNS)

# --- sources: payload text built from the tables, one payload per zone and day ---


def _iso(c: str = "ts"):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _per_day(df, record):
    """Payload rows hold one day of slots, so each gathers at most 96 records."""
    day = F.to_date("ts")
    return df.groupBy("zone", day.alias("_d")).agg(F.sort_array(F.collect_list(record)).alias("_rows")).withColumn(
        "source", F.date_format("_d", "yyyyMMdd")
    )


def imbalance_payloads(spark, sf):
    side = F.element_at(
        F.array(*[F.lit(x) for x in ("long", "Neutral", "SHORT")]), F.col("direction") + 2
    )
    rec = F.struct(
        _iso().alias("timestampUTC"),
        F.col("imbl_price").alias("imblSalesPrice"),
        side.alias("mainDirRegPowerPerMBA"),
        F.col("imbl_spot_diff").alias("imblSpotDifferencePrice"),
        F.col("up_reg_price").cast("string").alias("upRegPrice"),
        F.col("down_reg_price").alias("downRegPrice"),
    )
    days = _per_day(A.imbalance(spark, sf), rec)
    enveloped = F.to_json(F.struct(F.col("_rows").alias("data")))
    even = F.dayofmonth("_d") % 2 == 0
    return days.select("zone", "source", F.when(even, enveloped).otherwise(F.to_json("_rows")).alias("payload"))


@query(
    "read_imbalance_payload",
    "zone:s ts:t imbl_price:d direction:i imbl_spot_diff:d up_reg_price:d down_reg_price:d",
    IMB + "SELECT * FROM imb",
)
def read_imbalance_payload(spark, sf):
    return feeds.parse_imbalance(imbalance_payloads(spark, sf))


def hourly_payloads(df, fields):
    rec = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("time"), *[F.col(c).alias(f) for f, c in fields.items()])
    days = _per_day(df, rec)
    arrays = [F.col(f"_rows.{n}").alias(n) for n in ("time", *fields)]
    return days.select("zone", "source", F.to_json(F.struct(F.struct(*arrays).alias("hourly"))).alias("payload"))


@query(
    "read_weather_archive",
    "zone:s ts:t " + " ".join(f"{c}:d" for c in WX),
    WXQ + "SELECT * FROM wx",
)
def read_weather_archive(spark, sf):
    raw = hourly_payloads(A.weather(spark, sf), feeds.ARCHIVE_FIELDS)
    return feeds.parse_hourly_arrays(raw, feeds.ARCHIVE_FIELDS)


@query(
    "read_weather_forecast_history",
    "zone:s ts:t fcst_wind_100m:d fcst_wind_10m:d fcst_cloud_cover:d fcst_temperature:d",
    P.with_parts(P.EVENTS, P.WEATHER_FORECAST)
    + "SELECT zone, ts, NULL AS fcst_wind_100m, fcst_wind_10m, fcst_cloud_cover, fcst_temperature FROM wf",
)
def read_weather_forecast_history(spark, sf):
    have = {f: c for f, c in feeds.FORECAST_FIELDS.items() if f != "wind_speed_100m"}
    raw = hourly_payloads(A.weather_forecast(spark, sf), have)
    return feeds.parse_hourly_arrays(raw, feeds.FORECAST_FIELDS)


def point_payloads(spark, sf):
    """One payload per zone, site and day; the site is a user group."""
    e = A.events(spark, sf)
    site = F.concat(F.lit("site"), F.floor(F.col("user_id") / 4) % 4)
    rows = e.groupBy("zone", site.alias("location"), HOURLY.time_of(HOURLY.position()).alias("ts")).agg(
        F.avg("k").alias("w"), F.max("k").alias("g"), F.min("value").alias("t"), F.max("value").alias("p"),
        F.avg("value").alias("c"), (F.max("k") % 5).alias("sym"),
    )
    rec = F.struct(
        _iso().alias("time"),
        F.struct(
            F.col("w").alias("wind_speed"), F.col("g").alias("wind_speed_of_gust"),
            F.col("c").alias("cloud_area_fraction"), F.col("t").alias("air_temperature"),
            F.col("p").alias("probability_of_precipitation"), F.col("sym").alias("symbol_code"),
        ).alias("data"),
    )
    days = rows.groupBy("zone", "location", F.to_date("ts").alias("_d")).agg(
        F.sort_array(F.collect_list(rec)).alias("timeSeries")
    )
    return days.select(
        "zone", "location", F.date_format("_d", "yyyyMMdd").alias("source"),
        F.to_json(F.struct("timeSeries")).alias("payload"),
    )


_SITES = P.EVENTS + """, pt AS (
  SELECT zone, 'site' || CAST((user_id // 4) % 4 AS VARCHAR) AS location,
    time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(k) AS w, max(k) AS g, min(value) AS t,
    max(value) AS p, avg(value) AS c, max(k) % 5 AS sym FROM ev GROUP BY ALL)"""


@query(
    "read_point_series",
    "zone:s location:s ts:t fcst_wind_10m:d fcst_temperature:d fcst_cloud_cover:d fcst_wind_gust:d "
    "fcst_precip_prob:d fcst_thunderstorm_prob:d",
    "WITH " + _SITES
    + """SELECT zone, location, ts, w AS fcst_wind_10m, t AS fcst_temperature, c AS fcst_cloud_cover,
    g AS fcst_wind_gust, p AS fcst_precip_prob, NULL AS fcst_thunderstorm_prob FROM pt""",
)
def read_point_series(spark, sf):
    return feeds.parse_point_series(point_payloads(spark, sf), feeds.POINT_FORECAST_FIELDS, ["location"])


@query(
    "location_means",
    "zone:s ts:t smhi_wind_speed_ms:d smhi_wind_gust_ms:d smhi_cloud_fraction:d smhi_temperature_c:d "
    "smhi_precip_prob:d smhi_symbol_code:i",
    "WITH " + _SITES
    + """, n AS (SELECT zone, ts, sym, count(*) AS n FROM pt GROUP BY ALL),
    m AS (SELECT zone, ts, sym FROM n QUALIFY row_number() OVER (PARTITION BY zone, ts ORDER BY n DESC, sym) = 1)
    SELECT pt.zone, pt.ts, avg(w) AS smhi_wind_speed_ms, avg(g) AS smhi_wind_gust_ms,
    avg(c) AS smhi_cloud_fraction, avg(t) AS smhi_temperature_c, avg(p) AS smhi_precip_prob,
    any_value(m.sym) AS smhi_symbol_code
    FROM pt JOIN m ON pt.zone = m.zone AND pt.ts = m.ts GROUP BY pt.zone, pt.ts""",
)
def location_means(spark, sf):
    fields = {**feeds.LOCATION_FIELDS, "symbol_code": "symbol_code"}
    return feeds.location_means(feeds.parse_point_series(point_payloads(spark, sf), fields, ["location"]))


@query(
    "read_grid_series",
    "zone:s ts:t temperature:d cloudcover:d",
    WXQ
    + """, d AS (SELECT DISTINCT zone, date_trunc('day', ts)::TIMESTAMP AS d FROM wx),
    g AS (SELECT zone, unnest(generate_series(d, d + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS ts FROM d)
    SELECT g.zone, g.ts, temperature, cloudcover FROM g LEFT JOIN wx ON g.zone = wx.zone AND g.ts = wx.ts""",
)
def read_grid_series(spark, sf):
    w = A.weather(spark, sf)
    day = F.date_trunc("day", "ts")
    days = w.groupBy("zone", day.alias("d")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.hour("ts"), F.struct("temperature", "cloudcover")))).alias("m")
    )
    at = lambda c: F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.try_element_at("m", h)[c])
    start = F.unix_seconds("d")
    body = F.struct(
        start.alias("start"), (start + 86400).alias("end"), F.lit(3600).alias("interval"),
        F.array(at("temperature"), at("cloudcover")).alias("variables"),
    )
    raw = days.select("zone", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))
    return feeds.parse_grid_series(raw, ["temperature", "cloudcover"])


_GRID0, _GRID1 = "1995-01-01 00:00:00", "2001-08-10 00:00:00"


@query(
    "interval_expand",
    "zone:s ts:t nuclear_unavail_mw:d nuclear_unplanned_mw:d nuclear_outage_flag:i",
    P.with_parts(P.OUTAGES)
    + f""", n AS (SELECT * FROM outg WHERE plant_type ILIKE '%nuclear%'),
    l AS (SELECT * FROM n QUALIFY revision = max(revision) OVER (PARTITION BY mrid)),
    v AS (SELECT zone, start, "end", CASE WHEN nominal_power - avail_qty < 0 THEN 0
        ELSE nominal_power - avail_qty END AS mw,
      businesstype IS NULL OR lower(businesstype) LIKE 'unplanned%' OR lower(businesstype) NOT LIKE '%planned%' AS u
      FROM l),
    e AS (SELECT zone, unnest(generate_series(start, "end" - INTERVAL 1 SECOND, INTERVAL 1 HOUR)) AS ts, mw, u FROM v),
    c AS (SELECT zone, ts, sum(mw) AS mw, sum(CASE WHEN u THEN mw ELSE 0 END) AS un FROM e GROUP BY ALL),
    z AS (SELECT DISTINCT zone FROM l),
    g AS (SELECT zone, unnest(generate_series(TIMESTAMP '{_GRID0}', TIMESTAMP '{_GRID1}', INTERVAL 1 HOUR)) AS ts FROM z)
    SELECT g.zone, g.ts, coalesce(mw, 0) AS nuclear_unavail_mw, coalesce(un, 0) AS nuclear_unplanned_mw,
      CASE WHEN un > 0 THEN 1 ELSE 0 END AS nuclear_outage_flag
    FROM g LEFT JOIN c ON g.zone = c.zone AND g.ts = c.ts""",
)
def interval_expand(spark, sf):
    return feeds.nuclear_outages(A.outages(spark, sf), _GRID0, _GRID1, HOURLY)


@query(
    "latest_revision",
    "l_orderkey:i l_linenumber:i l_partkey:i l_quantity:d",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
    QUALIFY l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey)""",
)
def latest_revision(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    return grid.latest_revision(A.read(spark, sf, "lineitem").select(*cols), "l_orderkey", "l_linenumber")


@query(
    "generation_forecast",
    "zone:s ts:t wind_gen_forecast_mw:d solar_gen_forecast_mw:d",
    P.with_parts(P.EVENTS, P.GENERATION)
    + """, g AS (SELECT zone, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31',
      INTERVAL 15 MINUTE)) AS ts FROM (SELECT DISTINCT zone FROM gen))
    SELECT g.zone, g.ts, last_value(s.wind_gen_mw IGNORE NULLS) OVER
      (PARTITION BY g.zone ORDER BY g.ts ROWS 4 PRECEDING) AS wind_gen_forecast_mw,
      NULL AS solar_gen_forecast_mw
    FROM g LEFT JOIN gen s ON g.zone = s.zone AND g.ts = s.ts""",
)
def generation_forecast(spark, sf):
    rows = A.generation(spark, sf).select("zone", "ts", F.col("wind_gen_mw").alias("Wind Onshore"))
    return feeds.generation_forecast(rows, "2024-01-01", "2024-01-31")


@query("net_flow_outer", "zone:s ts:t border:s flow_mw:d", FLQ + "SELECT * FROM fl")
def net_flow_outer(spark, sf):
    sides = A.flow_sides(spark, sf)
    pick = lambda k: sides.where(F.col("side") == k).drop("side")
    return feeds.net_flows(pick("export"), pick("import"))


_FLOW_COLS = "zone:s ts:t " + " ".join(f"{c}:d" for c in [*FLOW, "net_position_mw"])


@query(
    "pivot_flows", _FLOW_COLS, P.with_parts(P.EVENTS, P.FLOWS, WIDE_FLOWS) + "SELECT * FROM nfl"
)
def pivot_flows(spark, sf):
    from gridtide.functions.scalars import row_sum

    wide = grid.pivot_wide(A.flows(spark, sf), ["zone", "ts"], "border", "flow_mw", A.BORDERS, "flow_{}_mw")
    return wide.withColumn("net_position_mw", row_sum(FLOW))


@query(
    "wide_flows_filled", _FLOW_COLS,
    P.with_parts(P.EVENTS, P.FLOWS, WIDE_FLOWS, FILLED_FLOWS) + "SELECT * FROM ffl",
)
def wide_flows_filled(spark, sf):
    return feeds.wide_flows(A.flows(spark, sf), A.BORDERS)


@query(
    "generation_mix",
    "zone:s ts:t wind_gen_mw:d nuclear_cap_mw:d load_mw:d",
    P.with_parts(P.EVENTS)
    + f""", w AS (SELECT zone, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(value + k) AS wind_gen_mw
      FROM ev WHERE event_type = 'click' GROUP BY ALL),
    l AS (SELECT zone, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(value) AS load_mw
      FROM ev WHERE event_type = 'view' GROUP BY ALL),
    o AS (SELECT coalesce(w.zone, l.zone) AS zone, coalesce(w.ts, l.ts) AS ts, wind_gen_mw, load_mw
      FROM w FULL JOIN l ON w.zone = l.zone AND w.ts = l.ts),
    s AS (SELECT zone, min(ts) AS lo, max(ts) AS hi FROM o GROUP BY zone),
    g AS (SELECT zone, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM s)
    SELECT g.zone, g.ts, last_value(wind_gen_mw IGNORE NULLS) OVER w3 AS wind_gen_mw,
      NULL AS nuclear_cap_mw, last_value(load_mw IGNORE NULLS) OVER w3 AS load_mw
    FROM g LEFT JOIN o ON g.zone = o.zone AND g.ts = o.ts
    WINDOW w3 AS (PARTITION BY g.zone ORDER BY g.ts ROWS 3 PRECEDING)""",
)
def generation_mix(spark, sf):
    e = A.events(spark, sf)
    wind = e.where(F.col("event_type") == "click").select("zone", "ts", "value", "k")
    load = e.where(F.col("event_type") == "view").select("zone", "ts", "value")
    return feeds.generation_mix(wind, None, load)


@query(
    "nuclear_actual",
    "zone:s ts:t nuclear_gen_mw:d",
    P.with_parts(P.EVENTS)
    + """, n AS (SELECT zone, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(k) AS x FROM ev
      WHERE event_type <> 'click' GROUP BY ALL),
    s AS (SELECT zone, min(ts) AS lo, max(ts) AS hi FROM n GROUP BY zone),
    g AS (SELECT zone, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM s)
    SELECT g.zone, g.ts, last_value(x IGNORE NULLS) OVER
      (PARTITION BY g.zone ORDER BY g.ts ROWS 3 PRECEDING) AS nuclear_gen_mw
    FROM g LEFT JOIN n ON g.zone = n.zone AND g.ts = n.ts""",
)
def nuclear_actual(spark, sf):
    e = A.events(spark, sf).where(F.col("event_type") != "click")
    return feeds.nuclear_actual(e.select("zone", "ts", F.col("k").alias("Nuclear (Actual)")))


@query(
    "local_time_instants",
    "o_orderkey:i first:t second:t",
    """WITH n AS (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS l FROM orders),
    u AS (SELECT o_orderkey, l, timezone('UTC', timezone('Europe/Stockholm', l)) AS t FROM n),
    b AS (SELECT *, timezone('Europe/Stockholm', timezone('UTC', t)) AS back,
      timezone('Europe/Stockholm', timezone('UTC', t + INTERVAL 1 HOUR)) AS back1,
      timezone('Europe/Stockholm', timezone('UTC', t - INTERVAL 1 HOUR)) AS back0 FROM u),
    f AS (SELECT o_orderkey, l, CASE WHEN back <> l THEN date_trunc('hour', t)
      WHEN back0 = l THEN t - INTERVAL 1 HOUR ELSE t END AS first,
      CASE WHEN back <> l THEN date_trunc('hour', t) WHEN back1 = l THEN t + INTERVAL 1 HOUR ELSE t END AS second FROM b)
    SELECT * FROM f""",
)
def local_time_instants(spark, sf):
    from gridtide.functions.calendar import second_occurrence, to_instant

    o = A.read(spark, sf, "orders")
    naive = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=F.col("o_orderkey").cast("int") % 1440)
    return o.select("o_orderkey", to_instant(naive).alias("first"), second_occurrence(naive).alias("second"))


@query(
    "scan_range",
    "event_id:i ts:t value:d",
    """SELECT event_id, ts, value FROM events
    WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 06:00:00'""",
)
def scan_range(spark, sf):
    # The bound is put in the column's own type so that it reaches the scan.
    e = A.read(spark, sf, "events").select("event_id", "ts", "value")
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 00:00:00", "2024-01-12 06:00:00"))
    return e.where(F.col("ts").between(lo, hi))


# --- table maintenance -------------------------------------------------------------


def _old_new(spark, sf):
    p = A.prices(spark, sf)
    t = lambda d: F.lit(d).cast("timestamp")
    old = p.where(F.col("ts") < t("2024-01-20"))
    new = p.where(F.col("ts") >= t("2024-01-15")).withColumn("price_eur_mwh", F.col("price_eur_mwh") + 1000)
    return old, new


_OLD_NEW = PR + """, o AS (SELECT * FROM pr WHERE ts < TIMESTAMP '2024-01-20'),
  n AS (SELECT zone, ts, price_eur_mwh + 1000 AS price_eur_mwh FROM pr WHERE ts >= TIMESTAMP '2024-01-15')"""


@query(
    "insert_ignore",
    "zone:s ts:t price_eur_mwh:d",
    _OLD_NEW + " SELECT * FROM o UNION ALL SELECT * FROM n WHERE ts >= TIMESTAMP '2024-01-20'",
)
def insert_ignore(spark, sf):
    return tables.ignore_rows(*_old_new(spark, sf), ["zone", "ts"])


@query(
    "insert_replace",
    "zone:s ts:t price_eur_mwh:d",
    _OLD_NEW + " SELECT * FROM n UNION ALL SELECT * FROM o WHERE ts < TIMESTAMP '2024-01-15'",
)
def insert_replace(spark, sf):
    return tables.merge_rows(*_old_new(spark, sf), ["zone", "ts"])


def _stored(spark):
    return tables.Store(spark, scratch_path(spark, "store"))


@query("store_ignore", "zone:s ts:t price_eur_mwh:d", _OLD_NEW + " SELECT * FROM o UNION ALL SELECT * FROM n WHERE ts >= TIMESTAMP '2024-01-20'")
def store_ignore(spark, sf):
    """Two batches into the stored table, the second one twice."""
    store, (old, new) = _stored(spark), _old_new(spark, sf)
    for rows in (old, new, new):
        store.insert_ignore("prices", rows)
    return store.scan("prices")


@query("store_replace", "zone:s ts:t price_eur_mwh:d", _OLD_NEW + " SELECT * FROM n UNION ALL SELECT * FROM o WHERE ts < TIMESTAMP '2024-01-15'")
def store_replace(spark, sf):
    store, (old, new) = _stored(spark), _old_new(spark, sf)
    store.insert_ignore("prices", old)
    store.insert_replace("prices", new)
    return store.scan("prices")


@query(
    "store_run",
    "zone:s ts:t generated_at:t p05:d p50:d p95:d",
    P.with_parts(P.EVENTS, P.PRICES, P.RUNS) + "SELECT zone, ts, generated_at, p05, p50, p95 FROM fc",
)
def store_run(spark, sf):
    """Forecast runs saved under their run time, the later half of them twice."""
    store, runs = _stored(spark), A.forecast_runs(spark, sf)
    store.save_run("forecasts", runs, F.col("generated_at"))
    store.save_run("forecasts", runs.where("ts >= '2024-01-15'").withColumn("p50", F.lit(0.0)), F.col("generated_at"))
    return store.scan("forecasts")


@query(
    "store_scan",
    "zone:s ts:t price_eur_mwh:d",
    PR + """SELECT zone, ts, price_eur_mwh FROM pr
    WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-09 18:00:00'""",
)
def store_scan(spark, sf):
    store = _stored(spark)
    store.insert_ignore("prices", A.prices(spark, sf))
    return store.scan("prices", "2024-01-05 06:00:00", "2024-01-09 18:00:00", ["zone", "ts", "price_eur_mwh"])


@query(
    "store_sync",
    "table_name:s first_ts:t last_ts:t n:i",
    P.with_parts(P.EVENTS, P.PRICES, P.WEATHER, P.IMBALANCE)
    + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM {v}"
        for t, v in (("prices", "pr"), ("weather", "wx"), ("imbalance_prices", "imb"))
    ),
)
def store_sync(spark, sf):
    """Three feeds taken in twice, then what the tables hold."""
    store = _stored(spark)
    rows = {"prices": A.prices(spark, sf), "weather": A.weather(spark, sf), "imbalance_prices": A.imbalance(spark, sf)}
    tables.sync(store, rows)
    return tables.sync(store, rows)


_PREDICTED = "2024-02-01 00:00:00"


@query(
    "store_predictions",
    "zone:s ts:t generated_at:t p05:d p50:d p95:d",
    P.with_parts(P.EVENTS, P.PRICES, P.DENSE_PRICES, P.RUNS, P.SCORED)
    + f"SELECT zone, ts, TIMESTAMP '{_PREDICTED}' AS generated_at, p05, p50, p95 FROM sc",
)
def store_predictions(spark, sf):
    """Predictions of a test set as a forecast run; saving them again changes nothing."""
    store, scored = _stored(spark), A.scored(spark, sf)
    for _ in range(2):
        store.save_predictions("forecasts", scored, F.lit(_PREDICTED))
    return store.scan("forecasts")


@query(
    "store_decisions",
    "zone:s ts:t current_threshold:d recommended_threshold:d decision:s applied:s",
    P.with_parts(P.EVENTS, P.PRICES)
    + """, d AS (SELECT zone, ts, 0.45 AS current_threshold, least(price_eur_mwh / 200, 1.0) AS recommended_threshold,
      CASE WHEN price_eur_mwh > 40 THEN 'applied' ELSE 'rejected' END AS decision FROM pr WHERE hour(ts) = 6)
    SELECT *, CASE WHEN decision = 'applied' THEN 'true' ELSE 'false' END AS applied FROM d""",
)
def store_decisions(spark, sf):
    """The log of threshold decisions, appended to in two parts."""
    store, log = _stored(spark), _decisions(spark, sf)
    for early in (True, False):
        store.append("threshold_decisions", log.where((F.col("ts") < "2024-01-15") == early))
    return store.scan("threshold_decisions")


def _decisions(spark, sf):
    p = F.col("price_eur_mwh")
    decision = F.when(p > 40, "applied").otherwise("rejected")
    return A.prices(spark, sf).where(F.hour("ts") == 6).select(
        "zone", "ts", F.lit(0.45).alias("current_threshold"), F.least(p / 200, F.lit(1.0)).alias("recommended_threshold"),
        decision.alias("decision"), F.lit("level").alias("reasoning"), (decision == "applied").alias("applied"),
    )


@query(
    "store_threshold",
    "threshold:d ts:t reason:s",
    P.with_parts(P.EVENTS, P.PRICES)
    + """, d AS (SELECT ts, avg(least(price_eur_mwh / 200, 1.0)) AS threshold FROM pr
      WHERE hour(ts) = 6 AND price_eur_mwh > 40 GROUP BY ts)
    SELECT threshold, ts, 'level' AS reason FROM d QUALIFY ts = max(ts) OVER ()""",
)
def store_threshold(spark, sf):
    """The threshold in force after the applied decisions of all mornings (their mean where
    several zones decide at once)."""
    store, log = _stored(spark), _decisions(spark, sf).where("decision = 'applied'")
    by_time = log.groupBy("ts", "decision", "reasoning").agg(F.avg("recommended_threshold").alias("recommended_threshold"))
    store.set_threshold(by_time.withColumn("zone", F.lit("all")))
    return store.get_threshold()


@query(
    "store_tables",
    "table_name:s n:i",
    "SELECT * FROM (VALUES " + ", ".join(f"('{n}')" for n in SCHEMAS if n != "prices")
    + ") t(table_name), (SELECT 0 AS n) UNION ALL " + P.with_parts(P.EVENTS, P.PRICES).replace("WITH", "SELECT * FROM (WITH", 1)
    + "SELECT 'prices', count(*) FROM pr)",
)
def store_tables(spark, sf):
    """All tables declared, one of them filled."""
    store = _stored(spark)
    store.ensure_tables()
    store.append("prices", A.prices(spark, sf))
    return tables.coverage({n: store.scan(n) for n in SCHEMAS}).select("table_name", "n")


@query(
    "csv_export",
    "zone:s ts:t p50:d",
    P.with_parts(P.EVENTS, P.PRICES, P.RUNS)
    + "SELECT zone, ts, round(p50 + 1e-9, 2) AS p50 FROM fc WHERE generated_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'",
)
def csv_export(spark, sf):
    """A range of forecasts written as CSV with two decimals and read again."""
    rows = A.forecast_runs(spark, sf).where(F.col("generated_at").between("2024-01-10", "2024-01-12"))
    path = scratch_path(spark, "csv")
    tables.export_csv(rows.select("zone", "ts", (F.col("p50") + 1e-9).alias("p50")), path)
    return spark.read.schema("zone string, ts timestamp, p50 double").option("header", True).csv(path)


@query(
    "saved_metrics",
    "zone:s n:i mae:d",
    P.with_parts(P.EVENTS, P.PRICES, P.DENSE_PRICES, P.RUNS, P.SCORED)
    + "SELECT zone, count(y) AS n, avg(abs(p50 - y)) AS mae FROM sc GROUP BY zone",
)
def saved_metrics(spark, sf):
    """Metrics of the scored rows, saved and read again."""
    path = scratch_path(spark, "metrics")
    tables.save_metrics(evaluate.eval_spot(A.scored(spark, sf), by=["zone"]), path)
    return spark.read.json(path)


@query(
    "filled_columns",
    "column_name:s n:i",
    P.with_parts(P.EVENTS, P.WEATHER, P.WEATHER_FORECAST)
    + """, v AS (SELECT wx.*, fcst_wind_10m, NULL AS smhi_wind_speed_ms FROM wx LEFT JOIN wf USING (zone, ts))"""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n FROM v HAVING count({c}) > 0" for c in ("temperature", "fcst_wind_10m", "smhi_wind_speed_ms")
    ),
)
def filled_columns(spark, sf):
    """Columns left after those without any value are dropped, with their values."""
    view = master.weather_view(
        A.weather(spark, sf), {"fcst": (A.weather_forecast(spark, sf), WF), "smhi": (None, ["smhi_wind_speed_ms"])}
    ).select("temperature", "fcst_wind_10m", "smhi_wind_speed_ms")
    left = projections.drop_all_null(view)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in left.columns])
    return left.select(F.inline(pairs)).groupBy("column_name").agg(F.count("x").alias("n"))


@query(
    "missing_tail",
    "zone:s border:s fetch_from:t fetch_to:t",
    FLQ
    + """, h AS (SELECT zone, border, max(ts) AS hi FROM fl
        WHERE NOT (zone = 'Z1' AND border = 'NO1') GROUP BY ALL),
    w AS (SELECT DISTINCT zone, border FROM fl)
    SELECT w.zone, w.border, coalesce(hi + INTERVAL 1 HOUR, TIMESTAMP '2023-12-01') AS fetch_from,
    TIMESTAMP '2024-01-30 22:00:00' AS fetch_to FROM w LEFT JOIN h USING (zone, border)
    WHERE hi IS NULL OR hi < TIMESTAMP '2024-01-30 22:00:00'""",
)
def missing_tail(spark, sf):
    fl = A.flows(spark, sf)
    have = fl.where(~((F.col("zone") == "Z1") & (F.col("border") == "NO1")))
    wanted = fl.select("zone", "border").distinct()
    return tables.missing_tail(have, wanted, "2023-12-01", "2024-01-30 22:00:00", 3600)


@query(
    "refresh_window",
    "zone:s ts:t price_eur_mwh:d",
    PR + """SELECT * FROM pr WHERE ts > TIMESTAMP '2024-01-25 12:00:00' - INTERVAL 16 DAY
    AND ts <= TIMESTAMP '2024-01-25 12:00:00'""",
)
def refresh_window(spark, sf):
    return tables.refresh_window(A.prices(spark, sf), F.lit("2024-01-25 12:00:00").cast("timestamp"))


@query(
    "coverage_report",
    "table_name:s first_ts:t last_ts:t n:i",
    P.with_parts(P.EVENTS, P.PRICES, P.WEATHER, P.IMBALANCE)
    + """SELECT 'prices' AS table_name, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM pr
    UNION ALL SELECT 'weather', min(ts), max(ts), count(*) FROM wx
    UNION ALL SELECT 'imbalance_prices', min(ts), max(ts), count(*) FROM imb
    UNION ALL SELECT 'nuclear_gen', NULL, NULL, 0""",
)
def coverage_report(spark, sf):
    return tables.coverage(
        {
            "prices": A.prices(spark, sf), "weather": A.weather(spark, sf),
            "imbalance_prices": A.imbalance(spark, sf), "nuclear_gen": None,
        }
    )


@query(
    "cap_end",
    "o_orderkey:i capped:s",
    """SELECT o_orderkey, strftime(least(CAST(o_orderdate AS DATE), DATE '1998-06-13'), '%Y-%m-%d') AS capped
    FROM orders""",
)
def cap_end(spark, sf):
    capped = feeds.cap_end(F.col("o_orderdate"), 2, F.lit("1998-06-15").cast("date"))
    return A.read(spark, sf, "orders").select("o_orderkey", F.date_format(capped, "yyyy-MM-dd").alias("capped"))


@query(
    "dedup_keep_last",
    "user_id:i ts:t event_id:i value:d",
    """SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS ts, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY event_id DESC) = 1""",
)
def dedup_keep_last(spark, sf):
    e = A.events(spark, sf).select("user_id", grid.bucket("ts", 3600).alias("ts"), "event_id", "value")
    return grid.dedup(e, ["user_id", "ts"], ["event_id"], "last")


@query(
    "dedup_keep_first",
    "user_id:i event_type:s event_id:i value:d",
    """SELECT user_id, event_type, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
)
def dedup_keep_first(spark, sf):
    e = A.events(spark, sf).select("user_id", "event_type", "ts", "event_id", "value")
    return grid.dedup(e, ["user_id", "event_type"], ["ts", "event_id"], "first")


@query(
    "union_dedup",
    "zone:s ts:t price_eur_mwh:d",
    _OLD_NEW + " SELECT * FROM o UNION ALL SELECT * FROM n WHERE ts >= TIMESTAMP '2024-01-20'",
)
def union_dedup(spark, sf):
    return projections.union_dedup(list(_old_new(spark, sf)), ["zone", "ts"])


@query(
    "align_schema",
    "zone:s ts:t temperature:d windspeed_10m:d windspeed_100m:d solar_radiation:d cloudcover:d",
    WXQ + """SELECT zone, ts, temperature, NULL AS windspeed_10m, windspeed_100m, NULL AS solar_radiation,
    cloudcover FROM wx""",
)
def align_schema(spark, sf):
    from gridtide.schemas import SCHEMAS

    part = A.weather(spark, sf).select("cloudcover", "temperature", "windspeed_100m", "zone", "ts")
    return projections.align_schema(part, SCHEMAS["weather"].schema)


@query(
    "number_coercion",
    "event_id:i x:d",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS x FROM events",
)
def number_coercion(spark, sf):
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    return projections.numbers(A.events(spark, sf).select("event_id", text.alias("x")), ["x"])


@query(
    "overlay_coalesce",
    "zone:s ts:t temperature:d fcst_temperature:d",
    P.with_parts(P.EVENTS, P.WEATHER, P.WEATHER_FORECAST)
    + """, d AS (SELECT zone, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM wx GROUP BY zone)
    SELECT d.zone, d.ts, coalesce(wx.temperature, wf.fcst_temperature) AS temperature, wf.fcst_temperature
    FROM d LEFT JOIN wx ON d.zone = wx.zone AND d.ts = wx.ts LEFT JOIN wf ON d.zone = wf.zone AND d.ts = wf.ts""",
)
def overlay_coalesce(spark, sf):
    a = grid.densify(A.weather(spark, sf).select("zone", "ts", "temperature"), HOURLY)
    b = A.weather_forecast(spark, sf).select(
        "zone", "ts", F.col("fcst_temperature").alias("temperature"), "fcst_temperature"
    )
    return grid.overlay(a, b, ["zone", "ts"], ["temperature", "fcst_temperature"])


@query(
    "median_fill",
    "zone:s ts:t price_eur_mwh:d",
    DPR
    + """, m AS (SELECT median(price_eur_mwh) AS med FROM dpr)
    SELECT zone, ts, coalesce(price_eur_mwh, med) AS price_eur_mwh FROM dpr, m""",
)
def median_fill(spark, sf):
    return grid.fill_median(A.dense_prices(spark, sf), ["price_eur_mwh"])


@query(
    "local_day_filter",
    "event_id:i value:d",
    P.with_parts(P.EVENTS)
    + f"""SELECT event_id, value FROM ev
    WHERE CAST({P.local('ts')} AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'""",
)
def local_day_filter(spark, sf):
    return projections.local_days(A.events(spark, sf), "2024-01-10", "2024-01-12").select("event_id", "value")


@query(
    "hour_sets",
    "event_id:i night:i peak:i overnight:i",
    P.with_parts(P.EVENTS)
    + f""", h AS (SELECT event_id, hour({P.local('ts')}) AS hour FROM ev)
    SELECT event_id, CAST(hour IN (23,0,1,2,3,4,5) AS INTEGER) AS night,
    CAST(hour IN (7,8,9,17,18,19,20) AS INTEGER) AS peak, CAST(hour < 6 AS INTEGER) AS overnight FROM h""",
)
def hour_sets(spark, sf):
    from gridtide.functions import calendar as cal

    sets = {"night": cal.NIGHT_HOURS, "peak": cal.PEAK_HOURS, "overnight": cal.OVERNIGHT_HOURS}
    return A.events(spark, sf).select("event_id", *[cal.in_hours("ts", h).alias(n) for n, h in sets.items()])


@query(
    "lookback_filter",
    "event_id:i ts:t",
    "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 168 HOUR",
)
def lookback_filter(spark, sf):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return projections.lookback(A.events(spark, sf), 168 * 3600, now).select("event_id", "ts")


@query(
    "min_rows_guard",
    "user_id:i event_id:i",
    "SELECT user_id, event_id FROM events QUALIFY count(*) OVER (PARTITION BY user_id) >= 67",
)
def min_rows_guard(spark, sf):
    return projections.min_rows(A.events(spark, sf).select("user_id", "event_id"), ["user_id"], 67)


@query(
    "text_filter",
    "mrid:i nuclear:i unplanned:i",
    P.with_parts(P.OUTAGES)
    + """SELECT mrid, CAST(plant_type ILIKE '%nuclear%' AS INTEGER) AS nuclear,
    CAST(businesstype IS NULL OR lower(businesstype) LIKE 'unplanned%'
      OR lower(businesstype) NOT LIKE '%planned%' AS INTEGER) AS unplanned FROM outg""",
)
def text_filter(spark, sf):
    from gridtide.functions.scalars import contains_ci, is_unplanned

    return A.outages(spark, sf).select(
        "mrid", contains_ci("plant_type", "Nuclear").alias("nuclear"), is_unplanned("businesstype").alias("unplanned")
    )


# --- joins -------------------------------------------------------------------------


def _actual(spark, sf):
    return A.dense_prices(spark, sf)


@query(
    "asof_run_join",
    "zone:s ts:t price_eur_mwh:d generated_at:t p50:d",
    FCQ
    + """, r AS (SELECT DISTINCT zone, generated_at FROM fc),
    a AS (SELECT d.*, r.generated_at FROM dpr d ASOF LEFT JOIN r ON d.zone = r.zone AND d.ts >= r.generated_at)
    SELECT a.zone, a.ts, a.price_eur_mwh, a.generated_at, f.p50
    FROM a LEFT JOIN fc f ON a.zone = f.zone AND a.ts = f.ts AND a.generated_at = f.generated_at""",
)
def asof_run_join(spark, sf):
    return joins.asof_run(_actual(spark, sf), A.forecast_runs(spark, sf))


@query(
    "asof_row_join",
    "zone:s ts:t price_eur_mwh:d generated_at:t p05:d p50:d p95:d",
    FCQ
    + """, b AS (SELECT * FROM fc WHERE generated_at <= ts
      QUALIFY row_number() OVER (PARTITION BY zone, ts ORDER BY generated_at DESC) = 1)
    SELECT d.zone, d.ts, d.price_eur_mwh, b.generated_at, p05, p50, p95
    FROM dpr d LEFT JOIN b ON d.zone = b.zone AND d.ts = b.ts""",
)
def asof_row_join(spark, sf):
    return joins.asof_row(_actual(spark, sf), A.forecast_runs(spark, sf), ["p05", "p50", "p95"])


@query(
    "latest_run",
    "zone:s ts:t generated_at:t p50:d",
    FCQ + "SELECT * FROM fc QUALIFY generated_at = max(generated_at) OVER (PARTITION BY zone)",
)
def latest_run(spark, sf):
    return joins.latest_run(A.forecast_runs(spark, sf))


@query(
    "score_join_all_runs",
    "zone:s ts:t generated_at:t p50:d price_eur_mwh:d abs_error:d",
    FCQ
    + """SELECT f.*, p.price_eur_mwh, abs(f.p50 - p.price_eur_mwh) AS abs_error
    FROM fc f JOIN pr p ON f.zone = p.zone AND f.ts = p.ts""",
)
def score_join_all_runs(spark, sf):
    j = A.forecast_runs(spark, sf).join(A.prices(spark, sf), ["zone", "ts"])
    return j.withColumn("abs_error", F.abs(F.col("p50") - F.col("price_eur_mwh")))


@query(
    "nearest_lookup",
    "event_id:i temperature:d",
    P.with_parts(P.EVENTS, P.WEATHER)
    + """, w AS (SELECT zone, ts, temperature FROM wx),
    p AS (SELECT e.event_id, e.ts AS t, w.ts AS pt, w.temperature AS pv FROM ev e
      ASOF LEFT JOIN w ON e.zone = w.zone AND e.ts >= w.ts),
    n AS (SELECT e.event_id, w.ts AS nt, w.temperature AS nv FROM ev e
      ASOF LEFT JOIN w ON e.zone = w.zone AND e.ts <= w.ts)
    SELECT event_id, CASE WHEN nt IS NULL OR t - pt <= nt - t THEN pv ELSE nv END AS temperature
    FROM p JOIN n USING (event_id)""",
)
def nearest_lookup(spark, sf):
    w = A.weather(spark, sf).select("zone", "ts", "temperature")
    return joins.nearest(A.events(spark, sf).select("zone", "ts", "event_id"), w, ["temperature"])


@query(
    "run_history",
    "zone:s generated_at:t n:i mean:d first_ts:t last_ts:t",
    DPR
    + """, r AS (SELECT DISTINCT zone, date_trunc('day', ts) + INTERVAL 22 HOUR AS generated_at FROM dpr)
    SELECT r.zone, r.generated_at, count(*) AS n, avg(price_eur_mwh) AS mean, min(d.ts) AS first_ts,
    max(d.ts) AS last_ts FROM dpr d JOIN r ON d.zone = r.zone AND d.ts <= r.generated_at
      AND d.ts > r.generated_at - INTERVAL 7 DAY GROUP BY ALL""",
)
def run_history(spark, sf):
    hist = A.dense_prices(spark, sf)
    at = F.date_trunc("day", "ts") + F.expr("INTERVAL 22 HOURS")
    runs = hist.select("zone", at.alias("generated_at")).distinct()
    return joins.run_history(hist, runs, 7 * 86400).groupBy("zone", "generated_at").agg(
        F.count(F.lit(1)).alias("n"), F.avg("price_eur_mwh").alias("mean"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


@query(
    "left_fill_join",
    "zone:s ts:t price_eur_mwh:d nuclear_gen_mw:d",
    P.with_parts(P.EVENTS, P.PRICES, P.DENSE_PRICES, P.NUCLEAR)
    + f"""SELECT d.zone, d.ts, d.price_eur_mwh, last_value(n.nuclear_gen_mw IGNORE NULLS)
    OVER (PARTITION BY d.zone ORDER BY d.ts ROWS 3 PRECEDING) AS nuclear_gen_mw
    FROM dpr d LEFT JOIN nuc n ON d.zone = n.zone AND d.ts = n.ts""",
)
def left_fill_join(spark, sf):
    return joins.left_fill(A.dense_prices(spark, sf), A.nuclear_gen(spark, sf), HOURLY, ["nuclear_gen_mw"])


@query(
    "hourly_imbalance_join",
    "zone:s ts:t price_eur_mwh:d imbl_price:d direction:d",
    P.with_parts(P.EVENTS, P.PRICES, P.IMBALANCE)
    + """SELECT p.*, h.imbl_price, h.direction FROM pr p LEFT JOIN (SELECT zone, date_trunc('hour', ts) AS ts,
    avg(imbl_price) AS imbl_price, avg(direction) AS direction FROM imb GROUP BY ALL) h
    ON p.zone = h.zone AND p.ts = h.ts""",
)
def hourly_imbalance_join(spark, sf):
    return A.prices(spark, sf).join(master.hourly_imbalance(A.imbalance(spark, sf)), ["zone", "ts"], "left")


@query(
    "generation_view",
    "zone:s ts:t wind_gen_mw:d nuclear_cap_mw:d load_mw:d nuclear_gen_mw:d",
    P.with_parts(P.EVENTS, P.GENERATION, P.NUCLEAR) + "SELECT * FROM gen LEFT JOIN nuc USING (zone, ts)",
)
def generation_view(spark, sf):
    return master.generation_view(A.generation(spark, sf), A.nuclear_gen(spark, sf))


@query(
    "weather_view",
    "zone:s ts:t temperature:d fcst_wind_10m:d smhi_wind_speed_ms:d",
    P.with_parts(P.EVENTS, P.WEATHER, P.WEATHER_FORECAST)
    + "SELECT wx.*, fcst_wind_10m, NULL AS smhi_wind_speed_ms FROM wx LEFT JOIN wf USING (zone, ts)",
)
def weather_view(spark, sf):
    return master.weather_view(
        A.weather(spark, sf),
        {"fcst": (A.weather_forecast(spark, sf), WF), "smhi": (None, ["smhi_wind_speed_ms"])},
    )


@query(
    "outer_align",
    "zone:s ts:t price_eur_mwh:d nuclear_gen_mw:d wind_gen_mw:d",
    P.with_parts(P.EVENTS, P.PRICES, P.NUCLEAR, P.GENERATION)
    + """ SELECT zone, ts, price_eur_mwh, nuclear_gen_mw, wind_gen_mw
    FROM pr FULL JOIN nuc USING (zone, ts) FULL JOIN gen USING (zone, ts)""",
)
def outer_align(spark, sf):
    p = A.prices(spark, sf)
    g = A.generation(spark, sf).select("zone", "ts", "wind_gen_mw")
    return joins.outer_align([p, A.nuclear_gen(spark, sf), g], ["zone", "ts"])


# --- limits ------------------------------------------------------------------------


@query(
    "latest_rows",
    "event_id:i ts:t value:d",
    "SELECT event_id, ts, value FROM events ORDER BY ts DESC LIMIT 24",
)
def latest_rows(spark, sf):
    return projections.latest(A.events(spark, sf), 24)


@query(
    "latest_rows_per_user",
    "user_id:i event_id:i ts:t",
    "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 5",
)
def latest_rows_per_user(spark, sf):
    return projections.latest_per(A.events(spark, sf), 5, ["user_id"])


@query(
    "last_row_per_user",
    "user_id:i event_id:i ts:t value:d",
    "SELECT user_id, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1",
)
def last_row_per_user(spark, sf):
    e = A.events(spark, sf).select("user_id", "ts", "event_id", "value")
    return projections.last_row(e, ["user_id"])


@query(
    "upcoming_rows",
    "zone:s ts:t p50:d",
    FCQ
    + """, l AS (SELECT * FROM fc QUALIFY generated_at = max(generated_at) OVER (PARTITION BY zone))
    SELECT zone, ts, p50 FROM l WHERE ts >= TIMESTAMP '2024-01-31 04:00:00'
    QUALIFY row_number() OVER (PARTITION BY zone ORDER BY ts) <= 12""",
)
def upcoming_rows(spark, sf):
    now = F.lit("2024-01-31 04:00:00").cast("timestamp")
    return projections.upcoming(A.forecast_runs(spark, sf), now, 12)


@query(
    "tail_days",
    "zone:s ts:t price_eur_mwh:d",
    PR
    + """, m AS (SELECT zone, max(ts) AS hi FROM pr GROUP BY zone)
    SELECT pr.* FROM pr JOIN m USING (zone) WHERE ts > hi - INTERVAL 5 DAY""",
)
def tail_days(spark, sf):
    return projections.tail_days(A.prices(spark, sf), 5)


@query(
    "sample_rows",
    "event_id:i value:d",
    "SELECT event_id, value FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 500",
)
def sample_rows(spark, sf):
    return projections.sample_n(A.events(spark, sf), 500, ["event_id"])


@query(
    "augment_window",
    "zone:s ts:t copies:i",
    P.with_parts(P.EVENTS, P.IMBALANCE, P.DENSE_IMBALANCE)
    + f""", n AS (SELECT zone, ts, max(CASE WHEN imbl_price > 60 OR imbl_price < -100 THEN 1 ELSE 0 END)
      OVER ({BY} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM dimb)
    SELECT zone, ts, 1 + near AS copies FROM n""",
)
def augment_window(spark, sf):
    from gridtide.functions.scalars import is_spike
    from gridtide.models.splits import augment

    df = A.dense_imbalance(spark, sf).select("zone", "ts", "imbl_price")
    out = augment(df, QUARTER, is_spike("imbl_price", 60.0, -100.0), k=2)
    return out.groupBy("zone", "ts").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "time_split",
    "zone:s part:s first_ts:t last_ts:t n:i",
    PR
    + """, m AS (SELECT zone, max(ts) - INTERVAL 7 DAY AS cut FROM pr GROUP BY zone)
    SELECT zone, CASE WHEN ts <= cut THEN 'train' ELSE 'test' END AS part, min(ts) AS first_ts,
    max(ts) AS last_ts, count(*) AS n FROM pr JOIN m USING (zone) GROUP BY ALL""",
)
def time_split(spark, sf):
    from gridtide.models.splits import time_split

    out = time_split(A.prices(spark, sf), 7)
    return out.groupBy("zone", "part").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")
    )


@query(
    "validation_tail",
    "zone:s ts:t valid:i",
    PR
    + f"""SELECT zone, ts, CASE WHEN row_number() OVER ({BY}) > count(*) OVER (PARTITION BY zone)
    - greatest(CAST(floor(count(*) OVER (PARTITION BY zone) * 0.1) AS BIGINT), 24) THEN 1 ELSE 0 END AS valid FROM pr""",
)
def validation_tail(spark, sf):
    from gridtide.models.splits import tail_fraction

    return tail_fraction(A.prices(spark, sf), HOURLY, 0.1, 24)
