"""Quarter-hour imbalance features.

Input: a dense 15-min frame (zone, ts, imbl_price, direction, ...).  Price and
direction enter lagged by at least one slot, observed weather at its own slot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.features.matrix import Matrix
from gridtide.functions import calendar as cal
from gridtide.functions.scalars import STRESS_HIGH, STRESS_LOW, clip, spike_class
from gridtide.operators.blocks import QUARTER, Series
from gridtide.operators.windows import (
    differs,
    growing,
    lagged,
    rolled,
    wide_mean,
)

EPS = 1e-6
# Longest reach: the 7-day wind mean, with room for the lags under other features.
REACH = 700
P1, D1 = "imbl_lag_1", "dir_lag_1"
TARGETS = ("target_price", "target_binary", "target_class")


def _c(name: str) -> Column:
    return F.col(name)


def price_lags(m: Matrix) -> None:
    for n in (1, 2, 4, 8, 16):
        m.lag(f"imbl_lag_{n}", "imbl_price", n)
    for n, name in ((4, "1h"), (8, "2h"), (16, "4h")):
        m.lag(f"imbl_lag_{name}", "imbl_price", n)


def direction_lags(m: Matrix) -> None:
    for n in (1, 2, 4, 8):
        m.lag(f"dir_lag_{n}", "direction", n)
    m.run("dir_streak", differs(_c(D1), _c("dir_lag_2")), lambda pos, at, first: pos - at + 1)


def price_rolls(m: Matrix) -> None:
    for name, n in (("1h", 4), ("4h", 16)):
        for agg in ("mean", "std"):
            m.window(1, **{f"imbl_roll_{name}_{agg}": lambda s, n=n, agg=agg: rolled(s, P1, n, agg)})
    m.window(1, **{c: (lambda s, c=c: growing(s, P1)[c]) for c in (f"_s_{P1}", f"_n_{P1}")})
    m.window(2, imbl_roll_1d_mean=lambda s: wide_mean(s, P1, 96))
    # The exponential mean of the lagged price is the lagged exponential mean.
    m.decayed_lag("imbl_ewa", "imbl_price", 8)
    m.drop(f"_s_{P1}", f"_n_{P1}")


def spreads(m: Matrix) -> None:
    if m.has("up_reg_price", "down_reg_price"):
        diff = _c("up_reg_price") - _c("down_reg_price")
        m.window(0, reg_spread=lambda s: F.lag(diff, 1).over(s.over))
    for c, name in (("imbl_spot_diff", "imbl_spot_diff_lag1"), ("spot_price", "spot_price_lag1")):
        if m.has(c):
            m.lag(name, c, 1)


def extremes(m: Matrix) -> None:
    m.rows(imbl_abs_lag1=F.abs(P1))
    for name, n in (("1h", 4), ("4h", 16)):
        for agg in ("max", "min"):
            m.window(1, **{f"imbl_roll_{name}_{agg}": lambda s, n=n, agg=agg: rolled(s, P1, n, agg)})


def zscores(m: Matrix) -> None:
    m.rows(
        **{
            f"price_zscore_{h}": (_c(P1) - _c(f"imbl_roll_{h}_mean")) / (_c(f"imbl_roll_{h}_std") + EPS)
            for h in ("1h", "4h")
        }
    )


def stress_proximity(m: Matrix) -> None:
    m.rows(
        stress_proximity_up=clip(F.lit(STRESS_HIGH) - _c(P1), upper=STRESS_HIGH),
        stress_proximity_down=clip(_c(P1) - F.lit(STRESS_LOW), upper=-STRESS_LOW),
    )


def _in_stress() -> Column:
    return F.coalesce(F.abs(P1) > STRESS_HIGH, F.lit(False))


def consecutive_stress(m: Matrix) -> None:
    m.window(1, _above=lambda s: _in_stress(), _above_prev=lambda s: lagged(s, _in_stress(), 1))
    m.run(
        "consecutive_stress",
        differs(_c("_above"), _c("_above_prev")),
        lambda pos, at, first: F.when(_c("_above"), pos - at).otherwise(F.lit(0)),
    )
    m.drop("_above", "_above_prev")


def periods_since_stress(m: Matrix) -> None:
    m.run(
        "periods_since_stress",
        _in_stress(),
        lambda pos, at, first: pos - F.coalesce(at, first - 1),
    )


def momentum(m: Matrix) -> None:
    m.lag("_p5", "imbl_price", 5)
    m.lag("_p17", "imbl_price", 17)
    m.rows(
        vol_acceleration=_c("imbl_roll_1h_std") - _c("imbl_roll_4h_std"),
        price_momentum_1h=_c(P1) - _c("_p5"),
        price_momentum_4h=_c(P1) - _c("_p17"),
    )
    m.drop("_p5", "_p17")


def flip_rates(m: Matrix) -> None:
    m.window(1, _flip=lambda s: differs(_c(D1), _c("dir_lag_2")).cast("int"))
    for name, n in (("1h", 4), ("4h", 16), ("1d", 96)):
        m.window(2, **{f"dir_flip_rate_{name}": lambda s, n=n: rolled(s, "_flip", n, "sum")})
    m.drop("_flip")


def spread_rolls(m: Matrix) -> None:
    if not m.has("up_reg_price", "down_reg_price"):
        return
    m.window(
        1,
        reg_spread_roll_1h=lambda s: rolled(s, "reg_spread", 4, "mean"),
        reg_spread_roll_4h=lambda s: rolled(s, "reg_spread", 16, "mean"),
    )
    m.rows(reg_spread_accel=_c("reg_spread_roll_1h") - _c("reg_spread_roll_4h"))


def regime_flips(m: Matrix) -> None:
    flip = lambda now, before: F.coalesce(
        (_c(D1) == now) & (_c("dir_lag_2") == before), F.lit(False)
    ).cast("int")
    m.rows(regime_flip_to_short=flip(1, -1), regime_flip_to_long=flip(-1, 1))


def calendar(m: Matrix, tz: str = cal.LOCAL_ZONE) -> None:
    """Local calendar fields, their cycles and harmonics, and the flags."""
    m.rows(**cal.calendar_fields(m.s.ts, tz))
    m.rows(
        **cal.cyclic({"hour": 24, "dayofweek": 7, "month": 12, "slot": 96}),
        **cal.harmonics(F.col("slot"), 96),
        **cal.flags(),
    )
    m.drop("_doy", "_day")


def wind_column(m: Matrix) -> str | None:
    return next((c for c in ("windspeed_100m", "windspeed_10m") if c in m.df.columns), None)


def wind(m: Matrix) -> None:
    w = wind_column(m)
    if w is None:
        return
    m.window(0, **{c: (lambda s, c=c: growing(s, w)[c]) for c in (f"_s_{w}", f"_n_{w}")})
    m.window(1, wind_7d_mean=lambda s: wide_mean(s, w, 672, 48))
    m.rows(
        wind_surprise=_c(w) - _c("wind_7d_mean"),
        wind_x_night=_c(w) * _c("is_night"),
        wind_x_peak=_c(w) * _c("is_peak"),
        wind_squared=_c(w) * _c(w),
    )
    m.rows(wind_surprise_x_stress=_c("wind_surprise") * _stress_weight())
    m.drop(f"_s_{w}", f"_n_{w}")


def _stress_weight() -> Column:
    return F.try_divide(F.lit(STRESS_HIGH), _c("stress_proximity_up") + 1)


def temperature(m: Matrix) -> None:
    if "temperature" in m.df.columns:
        m.rows(
            heating_degree=clip(15 - _c("temperature"), lower=0.0),
            temp_x_peak=_c("temperature") * _c("is_peak"),
            temp_x_winter=_c("temperature") * _c("is_winter"),
        )
        m.rows(demand_stress=_c("heating_degree") * _c("is_peak") * _c("is_winter"))
    if "cloudcover" in m.df.columns:
        m.lag("cloudcover_lag1", "cloudcover", 1)


def interactions(m: Matrix) -> None:
    if "temperature" in m.df.columns:
        m.window(2, _std_lag1=lambda s: lagged(s, "imbl_roll_1h_std", 1))
        m.rows(demand_stress_x_vol=_c("demand_stress") * _c("_std_lag1"))
        m.drop("_std_lag1")
    short = F.coalesce(_c(D1) == 1, F.lit(False)).cast("int")
    m.rows(short_streak_x_peak=_c("dir_streak") * short * _c("is_peak"))


def weather_forecast(m: Matrix) -> None:
    if m.has("fcst_wind_10m"):
        for c in ("fcst_wind_10m", "fcst_temperature", "fcst_cloud_cover", "fcst_wind_gust", "fcst_precip_prob"):
            if m.has(c):
                m.lag(f"{c}_lag1", c, 1)
        if m.has("fcst_thunderstorm_prob"):
            m.lag("fcst_thunderstorm_lag1", "fcst_thunderstorm_prob", 1)
        w = wind_column(m)
        if w is not None:
            ref = "fcst_wind_100m" if m.has("fcst_wind_100m") else "fcst_wind_10m"
            m.window(0, wind_forecast_surprise=lambda s: lagged(s, w, 1) - lagged(s, ref, 1))
    if m.has("mesan_wind_speed"):
        m.lag("mesan_wind_lag1", "mesan_wind_speed", 1)
        _lag_or_null(m, "mesan_cloud_lag1", "mesan_cloud_fraction", 1)


def _lag_or_null(m: Matrix, name: str, c: str, n: int) -> None:
    if c in m.df.columns:
        m.lag(name, c, n)
    else:
        m.rows(**{name: F.lit(None).cast("double")})


def nuclear(m: Matrix) -> None:
    if not m.has("nuclear_unavail_mw"):
        return
    m.lag("nuclear_unavail_lag1", "nuclear_unavail_mw", 1)
    _lag_or_null(m, "nuclear_unplanned_lag1", "nuclear_unplanned_mw", 1)
    _lag_or_null(m, "nuclear_outage_flag_lag1", "nuclear_outage_flag", 1)
    m.window(
        0,
        nuclear_sudden_drop=lambda s: lagged(s, "nuclear_unavail_mw", 1)
        - lagged(s, "nuclear_unavail_mw", 5),
    )
    u = _c("nuclear_unavail_lag1")
    m.rows(
        nuclear_x_peak=u * _c("is_peak"),
        nuclear_x_winter=u * _c("is_winter"),
        nuclear_x_stress_proximity=u * _stress_weight(),
    )


def generation_forecast(m: Matrix) -> None:
    if m.has("wind_gen_forecast_mw"):
        m.lag("wind_gen_forecast_lag4", "wind_gen_forecast_mw", 4)
        w = wind_column(m)
        if w is not None:
            m.window(
                0,
                wind_forecast_vs_actual=lambda s: lagged(s, w, 96)
                - lagged(s, "wind_gen_forecast_mw", 96),
            )
    if m.has("solar_gen_forecast_mw"):
        m.lag("solar_gen_forecast_lag4", "solar_gen_forecast_mw", 4)


def flow_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c.startswith("flow_") and c.endswith("_mw")]


def flows(m: Matrix) -> None:
    for c in flow_columns(m.df.columns):
        m.lag(f"{c}_lag4", c, 4)
    if m.has("net_position_mw"):
        m.lag("net_pos_lag4", "net_position_mw", 4)
        g = "net_pos_lag4"
        m.window(1, **{c: (lambda s, c=c: growing(s, g)[c]) for c in (f"_s_{g}", f"_n_{g}")})
        m.window(2, net_pos_roll1d=lambda s: wide_mean(s, g, 96, 12))
        m.drop(f"_s_{g}", f"_n_{g}")


def targets(m: Matrix, horizons: Sequence[int] = (1,), named: bool = False) -> None:
    """Price, spike and spike class so many slots ahead; ``named``: with the horizon as
    a suffix."""
    cls = spike_class("imbl_price")
    values = dict(zip(TARGETS, (F.col("imbl_price"), (cls > 0).cast("int"), cls)))
    for h in horizons:
        end = f"_{h}" if named else ""
        m.window(0, **{f"{n}{end}": (lambda s, x=x, h=h: F.lead(x, h).over(s.over)) for n, x in values.items()})
    m.rows(spike_class=cls, is_spike=(cls > 0).cast("int"))


def imbalance_features(
    df: DataFrame,
    horizon: int | Sequence[int] = 1,
    s: Series = QUARTER,
    have: set[str] | None = None,
    tz: str = cal.LOCAL_ZONE,
) -> DataFrame:
    """All feature groups and the targets over one dense frame; for several horizons the
    targets of each (``target_price_4``, ...) beside the same features.

    ``have`` names the columns that hold any value (``known_columns``); groups over
    other columns are left out.
    """
    horizons = [horizon] if isinstance(horizon, int) else list(horizon)
    missing = [c for c in ("imbl_price", "direction") if c not in df.columns]
    base = df.withColumns({c: F.lit(0.0) for c in missing}) if missing else df
    # A stored spread is not lagged; the feature of that name is.
    base = base.drop("reg_spread")
    m = Matrix(base, s, back=REACH, ahead=max(horizons), have=None if have is None else have | set(missing))
    for group in (
        price_lags, direction_lags, price_rolls, spreads, extremes, zscores, stress_proximity,
        consecutive_stress, periods_since_stress, momentum, flip_rates, spread_rolls, regime_flips,
    ):
        group(m)
    calendar(m, tz)
    for group in (wind, temperature, interactions, weather_forecast, nuclear, generation_forecast, flows):
        group(m)
    if "imbl_price" in df.columns:
        targets(m, horizons, not isinstance(horizon, int))
    return m.build()


# Ordered feature names by group.
BASE = [
    "imbl_lag_1", "imbl_lag_2", "imbl_lag_4", "imbl_lag_8", "imbl_lag_16",
    "imbl_lag_1h", "imbl_lag_2h", "imbl_lag_4h",
    "imbl_roll_1h_mean", "imbl_roll_1h_std", "imbl_roll_4h_mean", "imbl_roll_4h_std",
    "imbl_roll_1d_mean", "imbl_ewa",
    "dir_lag_1", "dir_lag_2", "dir_lag_4", "dir_lag_8", "dir_streak",
]
SPIKE = [
    "imbl_abs_lag1", "imbl_roll_1h_max", "imbl_roll_4h_max", "imbl_roll_1h_min", "imbl_roll_4h_min",
    "price_zscore_1h", "price_zscore_4h", "stress_proximity_up", "stress_proximity_down",
    "consecutive_stress", "vol_acceleration", "price_momentum_1h", "price_momentum_4h",
    "dir_flip_rate_1h", "dir_flip_rate_4h", "dir_flip_rate_1d",
    "reg_spread", "reg_spread_roll_1h", "reg_spread_roll_4h", "reg_spread_accel",
    "regime_flip_to_short", "regime_flip_to_long", "periods_since_stress",
    "imbl_spot_diff_lag1", "spot_price_lag1", "demand_stress_x_vol", "short_streak_x_peak",
]
CALENDAR = [
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos", "slot_sin", "slot_cos",
    "season", "is_night", "is_peak", "is_weekend", "is_holiday", "is_winter",
    *[f"{p}_{fn}_k{k}" for p, top in (("daily", 3), ("weekly", 3), ("annual", 2))
      for k in range(1, top + 1) for fn in ("sin", "cos")],
]
WEATHER = [
    "windspeed_100m", "windspeed_10m", "wind_7d_mean", "wind_surprise", "wind_x_night",
    "wind_x_peak", "wind_squared", "wind_surprise_x_stress", "temperature", "heating_degree",
    "temp_x_peak", "temp_x_winter", "demand_stress", "cloudcover", "cloudcover_lag1",
]
INTERACTIONS = ["demand_stress_x_vol", "short_streak_x_peak"]
FORECAST = [
    "fcst_wind_10m_lag1", "fcst_wind_100m", "fcst_temperature_lag1", "fcst_cloud_cover_lag1",
    "fcst_wind_gust_lag1", "fcst_precip_prob_lag1", "fcst_thunderstorm_lag1",
    "wind_forecast_surprise", "mesan_wind_lag1", "mesan_cloud_lag1",
]
NUCLEAR = [
    "nuclear_unavail_lag1", "nuclear_unplanned_lag1", "nuclear_outage_flag_lag1",
    "nuclear_sudden_drop", "nuclear_x_peak", "nuclear_x_winter", "nuclear_x_stress_proximity",
]
GENERATION = ["wind_gen_forecast_lag4", "wind_forecast_vs_actual", "solar_gen_forecast_lag4"]
REGULATION = ["reg_spread", "imbl_spot_diff_lag1", "spot_price_lag1"]


def feature_list(columns: list[str], mode: str = "regression", known: set[str] | None = None) -> list[str]:
    """Ordered features of a mode that exist (and hold values, if ``known`` says so)."""
    if mode not in ("regression", "spike", "regime"):
        raise ValueError(f"unknown mode {mode}")
    flow = [c for c in columns if c.startswith("flow_") and c.endswith("_lag4")]
    flow += ["net_pos_lag4", "net_pos_roll1d"]
    tail = FORECAST + NUCLEAR + GENERATION + flow
    if mode == "spike":
        wanted = BASE + SPIKE + CALENDAR + WEATHER + tail
    else:
        wanted = BASE + CALENDAR + WEATHER + INTERACTIONS + REGULATION + tail
    have = set(columns) if known is None else known & set(columns)
    return [c for c in dict.fromkeys(wanted) if c in have]
