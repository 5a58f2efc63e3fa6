"""Landed payload files to typed tables.

``payloads`` reads whole files as text rows (zone, source, payload); the ``parse_*``
functions turn such rows into series, so they also work on payload text that comes
from a table or a stream.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtide.functions.calendar import LOCAL_ZONE, second_occurrence, to_instant
from gridtide.functions.scalars import (
    clip,
    contains_ci,
    direction_code,
    is_unplanned,
    row_sum,
    to_number,
)
from gridtide.operators.blocks import HOURLY, QUARTER, Series
from gridtide.operators.grid import (
    dedup,
    densify,
    expand_intervals,
    ffill,
    latest_revision,
    net_series,
    pivot_wide,
    resample,
)
from gridtide.operators.joins import outer_align

# Payload field names and the columns they become.
IMBALANCE_FIELDS = {
    "imblSalesPrice": "imbl_price",
    "imblSpotDifferencePrice": "imbl_spot_diff",
    "upRegPrice": "up_reg_price",
    "downRegPrice": "down_reg_price",
}
ARCHIVE_FIELDS = {
    "temperature_2m": "temperature",
    "windspeed_10m": "windspeed_10m",
    "windspeed_100m": "windspeed_100m",
    "direct_radiation": "solar_radiation",
    "cloudcover": "cloudcover",
}
FORECAST_FIELDS = {
    "wind_speed_100m": "fcst_wind_100m",
    "wind_speed_10m": "fcst_wind_10m",
    "cloud_cover": "fcst_cloud_cover",
    "temperature_2m": "fcst_temperature",
}
POINT_FORECAST_FIELDS = {
    "wind_speed": "fcst_wind_10m",
    "air_temperature": "fcst_temperature",
    "cloud_area_fraction": "fcst_cloud_cover",
    "wind_speed_of_gust": "fcst_wind_gust",
    "probability_of_precipitation": "fcst_precip_prob",
    "thunderstorm_probability": "fcst_thunderstorm_prob",
}
POINT_ANALYSIS_FIELDS = {
    "wind_speed": "mesan_wind_speed",
    "air_temperature": "mesan_temperature",
    "cloud_area_fraction": "mesan_cloud_fraction",
    "wind_speed_of_gust": "mesan_wind_gust",
}
LOCATION_FIELDS = {
    "wind_speed": "smhi_wind_speed_ms",
    "wind_speed_of_gust": "smhi_wind_gust_ms",
    "cloud_area_fraction": "smhi_cloud_fraction",
    "air_temperature": "smhi_temperature_c",
    "probability_of_precipitation": "smhi_precip_prob",
}

_HAS_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def payloads(spark: SparkSession, path: str | Sequence[str], zone: str | None = None) -> DataFrame:
    """(zone, source, payload), one row per file.  The zone comes from a ``zone=``
    folder unless one is given."""
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.text(paths, wholetext=True).withColumnRenamed("value", "payload")
    raw = raw.withColumn("source", F.input_file_name())
    if zone is not None:
        raw = raw.withColumn("zone", F.lit(zone))
    return raw


def _instant(utc: Column, either: Column, again: Column, tz: str) -> Column:
    """Instant of a UTC text, else of a text that is local unless it has an offset."""
    naive = F.try_to_timestamp(either)
    stated = F.when(either.rlike(_HAS_OFFSET), naive)
    local = F.when(again, second_occurrence(naive, tz)).otherwise(to_instant(naive, tz))
    return F.coalesce(F.try_to_timestamp(utc), stated, local)


def parse_imbalance(raw: DataFrame, tz: str = LOCAL_ZONE) -> DataFrame:
    """Array of records, or an object holding it under ``data``.

    Numbers may arrive as text.  A local time met a second time within a payload is
    the later of the two instants of the autumn hour.
    """
    names = ["timestampUTC", "timestamp", "mainDirRegPowerPerMBA", *IMBALANCE_FIELDS]
    item = "array<struct<" + ",".join(f"{n}:string" for n in names) + ">>"
    text = F.col("payload")
    items = F.when(F.ltrim(text).startswith("["), F.from_json(text, item)).otherwise(
        F.from_json(text, f"data {item}")["data"]
    )
    rows = raw.select("zone", "source", F.posexplode(items).alias("_i", "_r"))
    r = lambda n: F.col(f"_r.{n}")
    seen = Window.partitionBy("zone", "source", r("timestamp")).orderBy("_i")
    again = r("timestampUTC").isNull() & (F.row_number().over(seen) > 1)
    rows = rows.withColumn("_again", again)
    out = rows.select(
        "zone",
        _instant(r("timestampUTC"), r("timestamp"), F.col("_again"), tz).alias("ts"),
        "source",
        "_i",
        *[to_number(r(f)).alias(c) for f, c in IMBALANCE_FIELDS.items()],
        direction_code(r("mainDirRegPowerPerMBA")).alias("direction"),
    ).where(F.col("ts").isNotNull())
    out = dedup(out, ["zone", "ts"], ["source", "_i"]).drop("source", "_i")
    return out.select(
        "zone", "ts", "imbl_price", "direction", "imbl_spot_diff", "up_reg_price", "down_reg_price"
    )


def parse_hourly_arrays(raw: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Object of parallel arrays under ``hourly``; an absent array gives NULLs."""
    schema = "hourly struct<time:array<string>," + ",".join(f"{f}:array<double>" for f in fields) + ">"
    h = F.from_json("payload", schema)["hourly"]
    rows = raw.withColumn("_h", h).select(
        "zone", "source", F.posexplode("_h.time").alias("_i", "_t"), "_h"
    )
    out = rows.select(
        "zone",
        F.try_to_timestamp("_t").alias("ts"),
        "source",
        *[F.get(F.col(f"_h.{f}"), F.col("_i")).alias(c) for f, c in fields.items()],
    )
    return dedup(out.where(F.col("ts").isNotNull()), ["zone", "ts"], ["source"]).drop("source")


def parse_point_series(raw: DataFrame, fields: Mapping[str, str], extra: Sequence[str] = ()) -> DataFrame:
    """``timeSeries[].{time, data{...}}`` with the wanted fields renamed; ``extra``
    columns of the payload row (a location) are kept as part of the key."""
    schema = (
        "timeSeries array<struct<time:string,data:struct<"
        + ",".join(f"{f}:double" for f in fields)
        + ">>>"
    )
    items = F.from_json("payload", schema)["timeSeries"]
    rows = raw.select("zone", "source", *extra, F.explode(items).alias("_r"))
    out = rows.select(
        "zone",
        *extra,
        F.try_to_timestamp("_r.time").alias("ts"),
        "source",
        *[F.col(f"_r.data.{f}").alias(c) for f, c in fields.items()],
    )
    out = out.where(F.col("ts").isNotNull())
    return dedup(out, ["zone", *extra, "ts"], ["source"]).drop("source")


def location_means(points: DataFrame, symbol: str = "symbol_code") -> DataFrame:
    """Mean over locations per time, and the most frequent weather symbol."""
    from gridtide.operators.aggregates import mean_by, mode_by

    cols = list(LOCATION_FIELDS.values())
    means = mean_by(points, ["zone", "ts"], cols)
    mode = mode_by(points, ["zone", "ts"], symbol)
    return means.join(mode.withColumnRenamed(symbol, "smhi_symbol_code"), ["zone", "ts"], "left")


def parse_grid_series(raw: DataFrame, names: Sequence[str]) -> DataFrame:
    """Values on a regular grid given by start, end (exclusive) and step in seconds."""
    schema = "start long, end long, interval long, variables array<array<double>>"
    p = raw.withColumn("_p", F.from_json("payload", schema))
    n = F.ceil((F.col("_p.end") - F.col("_p.start")) / F.col("_p.interval")).cast("int")
    slots = p.withColumn("_n", n).where("_n > 0").select(
        "zone", "_p", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i")
    )
    at = F.timestamp_seconds(F.col("_p.start") + F.col("_i") * F.col("_p.interval"))
    value = lambda k: F.get(F.get(F.col("_p.variables"), F.lit(k)), F.col("_i"))
    return slots.select("zone", at.alias("ts"), *[value(k).alias(c) for k, c in enumerate(names)])


def nuclear_outages(
    rows: DataFrame, grid_start: str, grid_end: str, s: Series = QUARTER
) -> DataFrame:
    """Outage reports to MW offline per slot: newest revision of each nuclear report,
    total, unplanned, and a flag for any unplanned outage."""
    nuc = rows.where(contains_ci("plant_type", "nuclear"))
    nuc = latest_revision(nuc, "mrid", "revision")
    lost = F.coalesce(to_number("nominal_power"), F.lit(0.0)) - F.coalesce(
        to_number("avail_qty"), F.lit(0.0)
    )
    nuc = nuc.withColumns(
        {"_mw": clip(lost, lower=0.0), "_unplanned": is_unplanned("businesstype")}
    )
    out = expand_intervals(
        nuc, s, "_mw", "start", "end", grid_start, grid_end,
        {"nuclear_unavail_mw": F.lit(True), "nuclear_unplanned_mw": F.col("_unplanned")},
    )
    return out.withColumn("nuclear_outage_flag", (F.col("nuclear_unplanned_mw") > 0).cast("int"))


def generation_forecast(
    rows: DataFrame, grid_start: str, grid_end: str, s: Series = QUARTER
) -> DataFrame:
    """The wind and solar columns (NULL where absent) on a dense grid, filled 4 slots."""
    pick = {"Wind Onshore": "wind_gen_forecast_mw", "Solar": "solar_gen_forecast_mw"}
    have = {
        c: F.col(f"`{f}`").cast("double") if f in rows.columns else F.lit(None).cast("double")
        for f, c in pick.items()
    }
    out = rows.select(*s.keys, s.ts, *[x.alias(c) for c, x in have.items()])
    out = out.groupBy(*s.keys, s.ts).agg(*[F.first(c, ignorenulls=True).alias(c) for c in have])
    return ffill(densify(out, s, grid_start, grid_end), s, list(have), limit=4)


def net_flows(exports: DataFrame, imports: DataFrame, s: Series = HOURLY) -> DataFrame:
    """Hourly mean of both sides per border, then export minus import."""
    by = Series(keys=(*s.keys, "border"), ts=s.ts, step=s.step, rows=s.rows)
    mean = lambda d: resample(d, by, {"flow_mw": F.avg("flow_mw")})
    return net_series(mean(exports), mean(imports), [*s.keys, s.ts, "border"], "flow_mw")


def wide_flows(
    flows: DataFrame, borders: Sequence[str], s: Series = HOURLY,
    limit: int | None = 3, fill: float | None = None,
) -> DataFrame:
    """One column per border plus the net position on a dense grid, filled forward."""
    wide = pivot_wide(flows, [*s.keys, s.ts], "border", "flow_mw", borders, "flow_{}_mw")
    cols = [f"flow_{b.lower()}_mw" for b in borders]
    wide = wide.withColumn("net_position_mw", row_sum(cols))
    return ffill(densify(wide, s), s, [*cols, "net_position_mw"], limit=limit, fill=fill)


def generation_mix(
    wind: DataFrame | None, nuclear: DataFrame | None, load: DataFrame | None, s: Series = HOURLY
) -> DataFrame:
    """Hourly means of three sources on their joint grid, filled 3 rows.

    A source's value columns are summed per row; a missing source is a NULL column.
    """
    named = {"wind_gen_mw": wind, "nuclear_cap_mw": nuclear, "load_mw": load}
    parts = []
    for name, df in named.items():
        if df is None:
            continue
        values = [c for c in df.columns if c not in (*s.keys, s.ts)]
        row = df.withColumn("_v", row_sum(values) if len(values) > 1 else F.col(values[0]))
        parts.append(resample(row, s, {name: F.avg("_v")}))
    out = outer_align(parts, [*s.keys, s.ts])
    for name, df in named.items():
        if df is None:
            out = out.withColumn(name, F.lit(None).cast("double"))
    out = out.select(*s.keys, s.ts, *named)
    return ffill(densify(out, s), s, list(named), limit=3)


def nuclear_actual(rows: DataFrame, s: Series = HOURLY) -> DataFrame:
    """The first column whose name contains "nuclear": hourly mean, filled 3 rows."""
    name = next((c for c in rows.columns if "nuclear" in c.lower()), None)
    if name is None:
        raise ValueError(f"no nuclear column among {rows.columns}")
    hourly = resample(rows, s, {"nuclear_gen_mw": F.avg(F.col(f"`{name}`"))}, dense=True)
    return ffill(hourly, s, ["nuclear_gen_mw"], limit=3)


def spot_prices(rows: DataFrame, quarter: bool = False) -> DataFrame:
    """Day-ahead price as stored (hourly), or spread over quarter hours."""
    if not quarter:
        return rows
    named = rows.withColumnRenamed("price_eur_mwh", "spot_price")
    return ffill(densify(named, QUARTER), QUARTER, ["spot_price"])


def cap_end(end: Column, days: int, today: Column | None = None) -> Column:
    """The earlier of a wanted end date and the last available day."""
    today = F.current_date() if today is None else today
    return F.least(end.cast("date"), F.date_sub(today, days))
