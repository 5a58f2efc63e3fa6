"""Hourly day-ahead features: everything derived from prices, generation, flows and
imbalance reaches back at least 24 hours, so one set serves training and forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.features.imbalance import flow_columns
from gridtide.features.matrix import Matrix
from gridtide.functions import calendar as cal
from gridtide.functions.scalars import clip
from gridtide.operators.blocks import HOURLY, Series
from gridtide.operators.windows import growing, lagged, rolled, wide_mean

# 720-hour mean of the price one day back.
REACH = 750
P24 = "price_lag_24h"

# Weights of the same-hour price anchor by lag in hours.
ANCHOR_WEIGHTS = {24: 0.35, 48: 0.25, 72: 0.17, 96: 0.11, 120: 0.06, 144: 0.04, 168: 0.02}
WEEK_LAGS = (24, 48, 72, 96, 120, 144, 168)


def _c(name: str) -> Column:
    return F.col(name)


def _total(terms) -> Column:
    terms = list(terms)
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def price_lags(m: Matrix) -> None:
    for n in (24, 48, 168):
        m.lag(f"price_lag_{n}h", "price_eur_mwh", n)


def price_anchor(m: Matrix) -> None:
    p = "price_eur_mwh"
    m.window(
        0,
        price_ewa=lambda s: _total(lagged(s, p, n) * w for n, w in ANCHOR_WEIGHTS.items()),
        price_3d_mean=lambda s: _total(lagged(s, p, n) for n in (24, 48, 72)) / 3,
    )
    m.rows(
        price_lag24_vs_ewa=_c(P24) - _c("price_ewa"),
        price_lag24_vs_3d=_c(P24) - _c("price_3d_mean"),
    )


def price_rolls(m: Matrix) -> None:
    m.window(1, **{c: (lambda s, c=c: growing(s, P24)[c]) for c in (f"_s_{P24}", f"_n_{P24}")})
    m.window(1, price_roll_168h_std=lambda s: rolled(s, P24, 168, "std"))
    m.window(
        2,
        price_roll_168h_mean=lambda s: wide_mean(s, P24, 168),
        price_roll_720h_mean=lambda s: wide_mean(s, P24, 720),
    )
    m.rows(regime_x_vol=_c("price_roll_720h_mean") * _c("price_roll_168h_std"))
    m.drop(f"_s_{P24}", f"_n_{P24}")


def calendar(m: Matrix, tz: str = cal.LOCAL_ZONE) -> None:
    fields = cal.calendar_fields(m.s.ts, tz)
    m.rows(**{n: fields[n] for n in ("hour", "dayofweek", "month", "_doy", "_day")})
    flags = cal.flags()
    flags.pop("is_winter")
    m.rows(
        **cal.cyclic({"hour": 24, "month": 12, "dayofweek": 7}),
        **cal.harmonics(F.col("hour"), 24),
        **flags,
    )
    m.drop("_doy", "_day")


def lag_x_hour(m: Matrix) -> None:
    m.rows(**{f"lag24_x_hour_{fn}": _c(P24) * _c(f"hour_{fn}") for fn in ("sin", "cos")})


def wind_column(columns: list[str]) -> str:
    return "windspeed_100m" if "windspeed_100m" in columns else "windspeed_10m"


def heating(m: Matrix) -> None:
    m.rows(heating_degree=clip(15 - _c("temperature"), lower=0.0))
    if {"cloudcover", "solar_radiation"} <= set(m.df.columns):
        m.rows(cloud_x_solar=_c("cloudcover") * _c("solar_radiation"))


def wind_surprise(m: Matrix) -> None:
    w = wind_column(m.df.columns)
    m.window(0, wind_7d_mean=lambda s: _total(lagged(s, w, n) for n in WEEK_LAGS) / 7)
    m.rows(wind_surprise=_c(w) - _c("wind_7d_mean"))
    m.rows(
        wind_surprise_x_night=_c("wind_surprise") * _c("is_night"),
        wind_vs_ewa=_c("wind_surprise") * _c("price_ewa"),
    )


def interaction_columns(w: str) -> dict[str, Column]:
    """Wind and temperature against times of day and year (made of the columns named)."""
    winter, summer = (_c("season") == 1).cast("int"), (_c("season") == 3).cast("int")
    return {
        "wind_x_night": _c(w) * _c("is_night"),
        "wind_x_peak": _c(w) * _c("is_peak"),
        "wind_x_weekend": _c(w) * _c("is_weekend"),
        "wind_x_winter": _c(w) * winter,
        "wind_x_summer": _c(w) * summer,
        "wind_squared": _c(w) * _c(w),
        "temp_x_night": _c("temperature") * _c("is_night"),
        "temp_x_peak": _c("temperature") * _c("is_peak"),
        "temp_x_winter": _c("temperature") * winter,
    }


def weather_interactions(m: Matrix) -> None:
    m.rows(**interaction_columns(wind_column(m.df.columns)))


def _or_null(m: Matrix, name: str, a: str, b: str) -> Column:
    have = {a, b} <= set(m.df.columns)
    return ((_c(a) - _c(b)) if have else F.lit(None).cast("double")).alias(name)


def forecast_surprise(m: Matrix) -> None:
    """Observed minus forecast wind and cloud; NULL columns without a forecast."""
    for c in ("fcst_wind_100m", "fcst_wind_10m", "fcst_cloud_cover", "fcst_temperature"):
        if c not in m.df.columns:
            m.rows(**{c: F.lit(None).cast("double")})
    m.rows(
        fcst_wind_surprise=_or_null(m, "fcst_wind_surprise", "windspeed_100m", "fcst_wind_100m"),
        fcst_cloud_surprise=_or_null(m, "fcst_cloud_surprise", "cloudcover", "fcst_cloud_cover"),
    )


def point_forecast(m: Matrix) -> None:
    w = wind_column(m.df.columns)
    surprise = _or_null(m, "smhi_wind_surprise", "smhi_wind_speed_ms", w)
    for c in ("smhi_wind_speed_ms", "smhi_wind_gust_ms", "smhi_cloud_fraction",
              "smhi_temperature_c", "smhi_precip_prob"):
        if c not in m.df.columns:
            m.rows(**{c: F.lit(None).cast("double")})
    m.rows(smhi_wind_surprise=surprise)


def generation(m: Matrix) -> None:
    if "wind_gen_mw" not in m.df.columns:
        return
    m.lag("wind_gen_lag24", "wind_gen_mw", 24)
    m.lag("load_lag24", "load_mw", 24)
    wind, load = _c("wind_gen_lag24"), _c("load_lag24")
    m.rows(
        wind_load_ratio=F.try_divide(wind, load + 1),
        wind_gen_x_night=wind * _c("is_night"),
        wind_gen_x_weekend=wind * _c("is_weekend"),
        load_residual=clip(load - wind, lower=0.0),
    )


def nuclear(m: Matrix) -> None:
    if m.has("nuclear_gen_mw"):
        m.lag("nuclear_gen_lag24", "nuclear_gen_mw", 24)
        m.window(
            0,
            nuclear_ramp_24h=lambda s: lagged(s, "nuclear_gen_mw", 24) - lagged(s, "nuclear_gen_mw", 48),
        )
        m.window(
            1,
            nuclear_shortfall=lambda s: rolled(s, "nuclear_gen_lag24", 168, "max")
            - _c("nuclear_gen_lag24"),
        )
        m.rows(nuclear_x_peak=_c("nuclear_gen_lag24") * _c("is_peak"))
    m.drop("nuclear_gen_mw")


def flows(m: Matrix) -> None:
    raw = flow_columns(m.df.columns)
    for c in raw:
        m.lag(f"{c}_lag24", c, 24)
        m.lag(f"{c}_lag168", c, 168)
    if "net_position_mw" in m.df.columns:
        m.lag("net_pos_lag24", "net_position_mw", 24)
        m.window(1, net_pos_roll7d=lambda s: rolled(s, "net_pos_lag24", 168, "mean"))
        if "flow_se4_mw" in raw:
            m.rows(se4_x_peak=_c("flow_se4_mw_lag24") * _c("is_peak"))
    # Same-hour flows would leak into a day-ahead model.
    m.drop(*raw, "net_position_mw")


def imbalance(m: Matrix) -> None:
    if not m.has("imbl_price"):
        return
    p = "imbl_price"
    spike = F.coalesce(F.abs(p) > 200, F.lit(False)).cast("int")
    m.lag("imbl_price_lag24", p, 24)
    m.lag("imbl_price_lag168", p, 168)
    m.window(0, imbl_spike_flag_lag24=lambda s: F.lag(spike, 24).over(s.over))
    m.window(
        1,
        imbl_roll_24h_mean=lambda s: rolled(s, "imbl_price_lag24", 24, "mean"),
        imbl_roll_24h_std=lambda s: rolled(s, "imbl_price_lag24", 24, "std"),
    )
    if "direction" in m.df.columns:
        m.lag("imbl_direction_lag24", "direction", 24)
    if {"up_reg_price", "down_reg_price"} <= set(m.df.columns):
        diff = _c("up_reg_price") - _c("down_reg_price")
        m.window(0, imbl_spread_lag24=lambda s: F.lag(diff, 24).over(s.over))


def same_hour(m: Matrix) -> None:
    """Further anchors: same-hour means and installed nuclear capacity."""
    p = "price_eur_mwh"
    m.window(
        0,
        price_same_hour_3d_mean=lambda s: _total(lagged(s, p, n) for n in (24, 48, 72)) / 3,
        price_same_hour_7d_mean=lambda s: _total(lagged(s, p, n) for n in WEEK_LAGS) / 7,
    )
    m.rows(
        price_lag24_vs_3d_mean=_c(P24) - _c("price_same_hour_3d_mean"),
        price_lag24_vs_hour_mean=_c(P24) - _c("price_same_hour_7d_mean"),
        wind_vs_price_anchor=_c("wind_surprise") * _c("price_same_hour_7d_mean"),
    )
    if m.has("nuclear_cap_mw"):
        m.lag("nuclear_cap_lag24", "nuclear_cap_mw", 24)
        m.lag("_cap25", "nuclear_cap_mw", 25)
        m.window(
            1,
            nuclear_cap_shortfall=lambda s: rolled(s, "_cap25", 168, "max") - _c("nuclear_cap_lag24"),
        )
        m.rows(nuclear_cap_x_peak=_c("nuclear_cap_lag24") * _c("is_peak"))
        m.drop("_cap25")


def spot_features(
    df: DataFrame,
    s: Series = HOURLY,
    have: set[str] | None = None,
    tz: str = cal.LOCAL_ZONE,
    anchors: bool = False,
) -> DataFrame:
    """All spot groups over one dense hourly frame (zone, ts, price_eur_mwh, weather...)."""
    m = Matrix(df, s, back=REACH, have=have)
    for group in (price_lags, price_anchor, price_rolls):
        group(m)
    calendar(m, tz)
    for group in (
        lag_x_hour, heating, wind_surprise, weather_interactions, forecast_surprise,
        point_forecast, generation, nuclear, flows, imbalance,
    ):
        group(m)
    if anchors:
        same_hour(m)
    return m.build()


# Ordered feature names by group.
PRICE = [
    "price_ewa", "price_lag24_vs_ewa", "price_3d_mean", "price_lag24_vs_3d",
    "price_lag_48h", "price_lag_168h", "price_roll_168h_mean", "price_roll_168h_std",
    "price_roll_720h_mean", "regime_x_vol",
]
HARMONICS = [
    f"{p}_{fn}_k{k}" for p, top in (("daily", 3), ("weekly", 3), ("annual", 2))
    for k in range(1, top + 1) for fn in ("sin", "cos")
]
CALENDAR = [
    "hour_sin", "hour_cos", "month_sin", "month_cos", "dow_sin", "dow_cos",
    "season", "is_night", "is_peak", "is_weekend", "is_holiday",
    "lag24_x_hour_sin", "lag24_x_hour_cos", *HARMONICS,
]
GENERATION = [
    "wind_gen_lag24", "load_lag24", "wind_load_ratio", "wind_gen_x_night",
    "wind_gen_x_weekend", "load_residual",
]
IMBALANCE = [
    "imbl_price_lag24", "imbl_price_lag168", "imbl_roll_24h_mean", "imbl_roll_24h_std",
    "imbl_direction_lag24", "imbl_spike_flag_lag24", "imbl_spread_lag24",
]


def feature_list(columns: list[str], known: set[str] | None = None) -> list[str]:
    weather = [
        "temperature", wind_column(columns), "cloudcover", "heating_degree", "wind_7d_mean",
        "wind_surprise", "wind_surprise_x_night", "wind_vs_ewa", "wind_x_night", "wind_x_peak",
        "wind_x_weekend", "wind_x_winter", "wind_x_summer", "wind_squared",
        "temp_x_night", "temp_x_peak", "temp_x_winter", "cloud_x_solar",
    ]
    nuclear = [c for c in columns if c.startswith("nuclear")]
    flow = [
        c for c in columns
        if ("flow_" in c and ("lag24" in c or "lag168" in c))
        or c in ("net_pos_lag24", "net_pos_roll7d", "se4_x_peak")
    ]
    wanted = PRICE + CALENDAR + weather + GENERATION + nuclear + flow + IMBALANCE
    have = set(columns) if known is None else known & set(columns)
    return [c for c in dict.fromkeys(wanted) if c in have]
