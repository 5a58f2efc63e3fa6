"""The driver tables in the roles of the engine's own tables.

Zones are ``user_id % 4``; a slot's price is a linear map of the mean event value,
its direction the balance of clicks and views, its weather comes from ``props.k``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.operators.blocks import HOURLY, QUARTER, Series
from gridtide.operators.grid import densify

BORDERS = ("SE4", "NO1", "DK1", "SE2")

# Scale of the signed price: 2 * value - 105 crosses both spike limits.
PRICE_SCALE = 2.0
PRICE_SHIFT = 105.0


# Columns of the driver tables, given so that no file is opened to infer them.
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone, ts, event_type, value, k, user_id, event_id)"""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("Z"), F.col("user_id") % 4).alias("zone"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        "user_id",
        "event_id",
    )


def imbalance(spark: SparkSession, sf_dir: str, s: Series = QUARTER) -> DataFrame:
    """Sparse 15-min imbalance table: only slots with events have a row."""
    e = events(spark, sf_dir)
    click = F.count_if(F.col("event_type") == "click")
    view = F.count_if(F.col("event_type") == "view")
    return e.groupBy("zone", s.time_of(s.position()).alias("ts")).agg(
        (F.avg("value") * PRICE_SCALE - PRICE_SHIFT).alias("imbl_price"),
        F.sign((click - view).cast("double")).cast("int").alias("direction"),
        (F.avg("value") - 34.0).alias("imbl_spot_diff"),
        F.max("value").alias("up_reg_price"),
        F.min("value").alias("down_reg_price"),
    )


def weather(spark: SparkSession, sf_dir: str, s: Series = HOURLY) -> DataFrame:
    e = events(spark, sf_dir)
    return e.groupBy("zone", s.time_of(s.position()).alias("ts")).agg(
        (F.avg("k") / 4 - 8).alias("temperature"),
        (F.avg("k") / 10).alias("windspeed_10m"),
        (F.max("k") / 6).alias("windspeed_100m"),
        F.min("k").alias("solar_radiation"),
        F.avg("k").alias("cloudcover"),
    )


def weather_forecast(spark: SparkSession, sf_dir: str, s: Series = HOURLY) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("event_type") != "error")
    return e.groupBy("zone", s.time_of(s.position()).alias("ts")).agg(
        (F.max("k") / 6).alias("fcst_wind_100m"),
        (F.avg("k") / 10).alias("fcst_wind_10m"),
        F.avg("k").alias("fcst_cloud_cover"),
        (F.avg("k") / 4 - 8).alias("fcst_temperature"),
    )


def prices(spark: SparkSession, sf_dir: str, s: Series = HOURLY) -> DataFrame:
    """Hourly spot price."""
    e = events(spark, sf_dir)
    return e.groupBy("zone", s.time_of(s.position()).alias("ts")).agg(
        F.avg("value").alias("price_eur_mwh")
    )


def generation(spark: SparkSession, sf_dir: str, s: Series = HOURLY) -> DataFrame:
    e = events(spark, sf_dir)
    part = lambda t: F.sum(F.when(F.col("event_type") == t, F.col("value")))
    return e.groupBy("zone", s.time_of(s.position()).alias("ts")).agg(
        part("click").alias("wind_gen_mw"),
        F.max("value").alias("nuclear_cap_mw"),
        F.sum("value").alias("load_mw"),
    )


def nuclear_gen(spark: SparkSession, sf_dir: str, s: Series = HOURLY) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("event_type").isin("view", "purchase", "error"))
    return e.groupBy("zone", s.time_of(s.position()).alias("ts")).agg(
        F.sum("k").alias("nuclear_gen_mw")
    )


def flow_sides(spark: SparkSession, sf_dir: str, s: Series = HOURLY) -> DataFrame:
    """(zone, ts, border, side, mw): user groups stand for borders, purchases are
    exports and signups imports."""
    e = events(spark, sf_dir).where(F.col("event_type").isin("purchase", "signup"))
    names = F.array(*[F.lit(b) for b in BORDERS])
    border = F.element_at(names, (F.floor(F.col("user_id") / 4) % 4 + 1).cast("int"))
    return e.groupBy(
        "zone",
        s.time_of(s.position()).alias("ts"),
        border.alias("border"),
        F.when(F.col("event_type") == "purchase", "export").otherwise("import").alias("side"),
    ).agg(F.sum("value").alias("flow_mw"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net flow per border, long form."""
    from gridtide.operators.grid import net_series

    sides = flow_sides(spark, sf_dir)
    on = ["zone", "ts", "border"]
    side = lambda k: sides.where(F.col("side") == k).drop("side")
    return net_series(side("export"), side("import"), on, "flow_mw")


def dense_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15-min table on a full grid with NULL rows in the holes."""
    return densify(imbalance(spark, sf_dir), QUARTER)


def dense_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(prices(spark, sf_dir), HOURLY)


def forecast_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone, ts, generated_at, p05, p50, p95, spike_proba): for each hour a run made
    at midnight of its day and a run made at noon of the day before.

    The midnight run repeats the price 24 h earlier, the noon run the one 48 h
    earlier; the band is 30 wide on either side.
    """
    p = prices(spark, sf_dir)
    hour = "INTERVAL {} HOURS"
    day = F.date_trunc("day", F.col("ts"))

    def run(lag: int, made: str) -> DataFrame:
        src = p.withColumn("ts", F.col("ts") + F.expr(hour.format(lag)))
        return src.select(
            "zone",
            "ts",
            (F.date_trunc("day", F.col("ts")) + F.expr(hour.format(made))).alias("generated_at"),
            F.col("price_eur_mwh").alias("p50"),
        )

    both = run(24, "0").unionByName(run(48, "-12"))
    return both.select(
        "zone", "ts", "generated_at",
        (F.col("p50") - 30).alias("p05"), "p50", (F.col("p50") + 30).alias("p95"),
        (F.col("p50") / 200).alias("spike_proba"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly actuals with the as-of forecast, the previous price and spike labels:
    (zone, ts, y, p05, p50, p95, lag1, spike_proba, y_spike)."""
    from gridtide.operators.blocks import windowed
    from gridtide.operators.joins import asof_row

    y = dense_prices(spark, sf_dir)
    y = windowed(y, HOURLY, [lambda s: {"lag1": F.lag("price_eur_mwh", 1).over(s.over)}], back=1)
    out = asof_row(
        y, forecast_runs(spark, sf_dir), ["p05", "p50", "p95", "spike_proba"], how="inner"
    )
    return out.where(F.col("price_eur_mwh").isNotNull()).select(
        "zone", "ts", F.col("price_eur_mwh").alias("y"),
        "p05", "p50", "p95", "lag1",
        F.least(F.col("spike_proba"), F.lit(1.0)).alias("spike_proba"),
        (F.col("price_eur_mwh") > 60).cast("int").alias("y_spike"),
    )


def outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as outage reports: (zone, mrid, revision, plant_type, businesstype,
    nominal_power, avail_qty, start, end)."""
    o = read(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("Z"), F.col("o_custkey") % 4).alias("zone"),
        F.floor(n / 2).alias("mrid"),
        (n % 2).cast("int").alias("revision"),
        F.when(n % 3 == 0, "Nuclear").when(n % 3 == 1, "nuclear unit").otherwise("Hydro").alias("plant_type"),
        F.when(F.col("o_orderpriority").startswith("1"), "Unplanned outage")
        .when(F.col("o_orderpriority").startswith("5"), F.lit(None).cast("string"))
        .otherwise("Planned maintenance")
        .alias("businesstype"),
        (F.col("o_totalprice") / 1000).alias("nominal_power"),
        F.lit(50.0).alias("avail_qty"),
        F.col("o_orderdate").cast("timestamp").alias("start"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(n % 70) + F.lit(1))).alias("end"),
    )


def analysis(spark: SparkSession, sf_dir: str, s: Series = HOURLY) -> DataFrame:
    """Analysed weather of the past."""
    e = events(spark, sf_dir).where(F.col("event_type").isin("click", "signup", "error"))
    return e.groupBy("zone", s.time_of(s.position()).alias("ts")).agg(
        (F.avg("k") / 9).alias("mesan_wind_speed"),
        (F.min("k") / 5 - 6).alias("mesan_temperature"),
        (F.max("k") / 100).alias("mesan_cloud_fraction"),
        (F.max("k") / 4).alias("mesan_wind_gust"),
    )


def live_forecast(spark: SparkSession, sf_dir: str, s: Series = HOURLY) -> DataFrame:
    """A second weather forecast, with more measures."""
    e = events(spark, sf_dir).where(F.col("event_type") != "view")
    return e.groupBy("zone", s.time_of(s.position()).alias("ts")).agg(
        (F.avg("k") / 11).alias("fcst_wind_10m"),
        (F.max("k") / 4 - 8).alias("fcst_temperature"),
        F.min("k").alias("fcst_cloud_cover"),
        (F.max("k") / 3).alias("fcst_wind_gust"),
        (F.avg("k") / 100).alias("fcst_precip_prob"),
        (F.min("k") / 100).alias("fcst_thunderstorm_prob"),
    )


def generation_rows(spark: SparkSession, sf_dir: str, s: Series = HOURLY) -> DataFrame:
    """Wind and solar forecast under their feed's names."""
    e = events(spark, sf_dir)
    part = lambda t: F.sum(F.when(F.col("event_type") == t, F.col("value")))
    return e.groupBy("zone", s.time_of(s.position()).alias("ts")).agg(
        part("purchase").alias("Wind Onshore"), part("signup").alias("Solar")
    )


def unit_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as outage reports of a user's unit, in the days of the price table."""
    e = events(spark, sf_dir).where(F.col("event_type") == "error")
    kind = F.col("event_id") % 3
    return e.select(
        "zone",
        F.col("user_id").alias("mrid"),
        (F.col("event_id") % 2).cast("int").alias("revision"),
        F.when(F.col("user_id") % 5 == 0, "Hydro").otherwise("Nuclear").alias("plant_type"),
        F.when(kind == 0, "Unplanned outage").when(kind == 1, "Planned maintenance").alias("businesstype"),
        F.col("value").alias("nominal_power"),
        F.lit(20.0).alias("avail_qty"),
        F.col("ts").alias("start"),
        (F.col("ts") + F.make_dt_interval(hours=F.col("event_id") % 9 + F.lit(1))).alias("end"),
    )


def location_forecast(spark: SparkSession, sf_dir: str, s: Series = HOURLY) -> DataFrame:
    """Forecast means over locations."""
    e = events(spark, sf_dir).where(F.col("event_type") != "purchase")
    return e.groupBy("zone", s.time_of(s.position()).alias("ts")).agg(
        (F.avg("k") / 8).alias("smhi_wind_speed_ms"),
        (F.max("k") / 5).alias("smhi_wind_gust_ms"),
        F.avg("k").alias("smhi_cloud_fraction"),
        (F.min("k") / 4 - 8).alias("smhi_temperature_c"),
        (F.avg("k") / 100).alias("smhi_precip_prob"),
    )
