"""Scalar rules as Column expressions.

Missing values are NULL everywhere; ``no_nan`` is applied where floats enter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spike limits in EUR/MWh and regime probabilities.
STRESS_HIGH = 200.0
STRESS_LOW = -100.0
EXTREME_HIGH = 1000.0
EXTREME_LOW = -500.0
REGIME_EXTREME = 0.45
REGIME_STRESS = 0.15


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c: str | Column) -> Column:
    """NaN is missing, so it becomes NULL (``NaN > x`` would be true otherwise)."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def to_number(c: str | Column) -> Column:
    """Number or NULL; text that does not parse is NULL rather than an error."""
    return no_nan(col(c).try_cast("double"))


def clip(c: str | Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Clip that keeps NULL (``least``/``greatest`` would replace it by the bound)."""
    c = col(c)
    out = c
    if upper is not None:
        out = F.when(c > upper, F.lit(upper)).otherwise(out)
    if lower is not None:
        out = F.when(c < lower, F.lit(lower)).otherwise(out)
    return out


def finite_or_zero(c: str | Column) -> Column:
    c = col(c).cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def direction_code(c: str | Column) -> Column:
    """LONG/NEUTRAL/SHORT in any case, or a number by its sign; unknown is 0."""
    c = col(c).cast("string")
    text = F.upper(F.trim(c))
    return (
        F.when(text == "LONG", F.lit(-1))
        .when(text == "NEUTRAL", F.lit(0))
        .when(text == "SHORT", F.lit(1))
        .otherwise(F.coalesce(F.sign(to_number(c)).cast("int"), F.lit(0)))
        .cast("int")
    )


def spike_class(price: str | Column) -> Column:
    """0 normal, 1 stress, 2 extreme; a missing price is normal."""
    p = col(price)
    return (
        F.when((p > EXTREME_HIGH) | (p < EXTREME_LOW), F.lit(2))
        .when((p > STRESS_HIGH) | (p < STRESS_LOW), F.lit(1))
        .otherwise(F.lit(0))
    )


def is_spike(price: str | Column, high: float = STRESS_HIGH, low: float | None = STRESS_LOW) -> Column:
    """Beyond ``high``, or below ``low`` where one is given; missing is no spike."""
    p = col(price)
    hit = p > high
    if low is not None:
        hit = hit | (p < low)
    return F.coalesce(hit, F.lit(False))


def normal_class(price: str | Column, p33: float | Column, p67: float | Column) -> Column:
    p = col(price)
    return F.when(p < p33, F.lit(0)).when(p >= p67, F.lit(2)).otherwise(F.lit(1))


def regime(
    proba: str | Column,
    direction: str | Column,
    price: str | Column,
    extreme: float = REGIME_EXTREME,
    stress: float = REGIME_STRESS,
) -> Column:
    q, d, p = col(proba), col(direction), col(price)
    return (
        F.when(q >= extreme, F.lit("extreme"))
        .when(q >= stress, F.lit("stress"))
        .when((d < 0) & (p < STRESS_LOW), F.lit("deep_long"))
        .when(d < 0, F.lit("normal_long"))
        .otherwise(F.lit("normal_short"))
    )


def contains_ci(c: str | Column, text: str) -> Column:
    """Case-insensitive substring test; a missing text does not match."""
    return F.coalesce(F.lower(col(c).cast("string")).contains(text.lower()), F.lit(False))


def is_unplanned(business_type: str | Column) -> Column:
    """Text that starts with "unplanned", or that never says "planned"."""
    t = F.lower(F.trim(col(business_type).cast("string")))
    return F.coalesce(t.startswith("unplanned") | ~t.contains("planned"), F.lit(True))


def accuracy_rating(mean_abs_error: str | Column) -> Column:
    e = col(mean_abs_error)
    return (
        F.when(e < 10, F.lit("good")).when(e < 25, F.lit("moderate")).when(e.isNotNull(), F.lit("poor"))
    )


def zscore_class(z: str | Column, k: float = 2.0) -> Column:
    z = col(z)
    return F.when(z > k, F.lit("high")).when(z < -k, F.lit("low")).otherwise(F.lit("normal"))


def age_band(minutes: str | Column) -> Column:
    m = col(minutes)
    return F.when(m < 180, F.lit("ok")).when(m < 720, F.lit("warn")).otherwise(F.lit("stale"))


def age_label(minutes: str | Column) -> Column:
    """Whole minutes below an hour, hours below a day, days beyond."""
    m = F.floor(col(minutes))
    return (
        F.when(m < 60, F.concat(m.cast("string"), F.lit(" min")))
        .when(m < 1440, F.concat(F.floor(m / 60).cast("string"), F.lit(" h")))
        .otherwise(F.concat(F.floor(m / 1440).cast("string"), F.lit(" d")))
    )


def title_case(c: str | Column) -> Column:
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


def row_sum(cols: list[str]) -> Column:
    """Sum across columns; missing counts as 0, so an all-missing row gives 0."""
    out = F.lit(0.0)
    for c in cols:
        out = out + F.coalesce(F.col(c), F.lit(0.0))
    return out


def reg_spread(columns: list[str]) -> Column:
    """Up minus down regulation price, NULL where either column is absent."""
    if {"up_reg_price", "down_reg_price"} <= set(columns):
        return F.col("up_reg_price") - F.col("down_reg_price")
    return F.lit(None).cast("double")


def net_of(export: str | Column, imported: str | Column) -> Column:
    """Export minus import; one missing side counts as 0, both missing is NULL."""
    e, i = col(export), col(imported)
    return F.when(
        e.isNotNull() | i.isNotNull(), F.coalesce(e, F.lit(0.0)) - F.coalesce(i, F.lit(0.0))
    )
