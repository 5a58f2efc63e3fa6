"""Stored tables: their columns, keys and partitioning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_D, _S, _I, _TS, _B = T.DoubleType(), T.StringType(), T.IntegerType(), T.TimestampType(), T.BooleanType()


@dataclass(frozen=True)
class TableDef:
    schema: T.StructType
    key: tuple[str, ...]
    step: int | None = 3600


def _table(key: str, step: int | None, **cols: T.DataType) -> TableDef:
    fields = [T.StructField("zone", _S), T.StructField("ts", _TS)]
    fields += [T.StructField(n, t) for n, t in cols.items()]
    return TableDef(T.StructType(fields), tuple(key.split()), step)


def _doubles(*names: str) -> dict[str, T.DataType]:
    return {n: _D for n in names}


SCHEMAS: dict[str, TableDef] = {
    "prices": _table("zone ts", 3600, **_doubles("price_eur_mwh")),
    "weather": _table(
        "zone ts", 3600,
        **_doubles("temperature", "windspeed_10m", "windspeed_100m", "solar_radiation", "cloudcover"),
    ),
    "generation": _table("zone ts", 3600, **_doubles("wind_gen_mw", "nuclear_cap_mw", "load_mw")),
    "nuclear_gen": _table("zone ts", 3600, **_doubles("nuclear_gen_mw")),
    "cross_border_flows": _table("zone ts border", 3600, border=_S, flow_mw=_D),
    "forecasts": _table("zone ts generated_at", 3600, generated_at=_TS, **_doubles("p05", "p50", "p95")),
    "smhi_wind_forecast": _table(
        "zone ts", 3600,
        **_doubles("smhi_wind_speed_ms", "smhi_wind_gust_ms", "smhi_cloud_fraction",
                   "smhi_temperature_c", "smhi_precip_prob"),
        smhi_symbol_code=_I, fetched_at=_TS,
    ),
    "weather_forecast": _table(
        "zone ts", 3600,
        **_doubles("fcst_wind_100m", "fcst_wind_10m", "fcst_cloud_cover", "fcst_temperature"),
    ),
    "imbalance_prices": _table(
        "zone ts", 900,
        imbl_price=_D, direction=_I,
        **_doubles("reg_spread", "imbl_spot_diff", "up_reg_price", "down_reg_price"),
    ),
    "imbalance_forecasts": _table(
        "zone ts generated_at", 900,
        generated_at=_TS, **_doubles("p05", "p50", "p95", "spike_proba"), regime=_S,
    ),
    "threshold_decisions": _table(
        "", None,
        **_doubles("current_threshold", "recommended_threshold"),
        action=_S, decision=_S, reasoning=_S, confidence=_S,
        **_doubles("recall", "precision_val", "f2"), applied=_B,
    ),
    "thresholds": _table("", None, threshold=_D, reason=_S),
}
