"""Calendar columns of an instant, taken in a named local zone."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Europe/Stockholm"

# Local hours of the night and of the two daily peaks.
NIGHT_HOURS = (23, 0, 1, 2, 3, 4, 5)
PEAK_HOURS = (7, 8, 9, 17, 18, 19, 20)
OVERNIGHT_HOURS = (0, 1, 2, 3, 4, 5)
WINTER_MONTHS = (12, 1, 2)


def local(ts: str | Column, tz: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(F.col(ts) if isinstance(ts, str) else ts, tz)


def local_date(ts: str | Column, tz: str = LOCAL_ZONE) -> Column:
    return F.to_date(local(ts, tz))


def in_hours(ts: str | Column, hours: tuple[int, ...], tz: str = LOCAL_ZONE) -> Column:
    return F.hour(local(ts, tz)).isin(*hours)


def season(month: Column) -> Column:
    """1 winter, 2 spring, 3 summer, 4 autumn."""
    return (F.floor((month % 12) / 3) + 1).cast("int")


def season_name(month: Column) -> Column:
    return F.element_at(
        F.array(*[F.lit(x) for x in ("winter", "spring", "summer", "autumn")]), season(month)
    )


def to_instant(naive: Column, tz: str = LOCAL_ZONE) -> Column:
    """Instant of a naive local time.

    A time skipped by the spring change moves forward to the first instant after
    the gap; a time met twice in autumn is its first occurrence (see
    ``second_occurrence`` for the other).
    """
    t = F.to_utc_timestamp(naive, tz)
    back = F.from_utc_timestamp(t, tz)
    # In a gap the round trip lands later than asked for; the gap ends where local
    # time jumps, on a whole hour of the instant line.
    return F.when(back == naive, t).otherwise(F.date_trunc("hour", t))


def second_occurrence(naive: Column, tz: str = LOCAL_ZONE) -> Column:
    """The later instant of a repeated local time, else the only one."""
    first = to_instant(naive, tz)
    later = first + F.expr("INTERVAL 1 HOUR")
    return F.when(F.from_utc_timestamp(later, tz) == naive, later).otherwise(first)


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the anonymous (Meeus/Jones/Butcher) rule."""

    def div(a: Column, b: int) -> Column:
        return F.floor(a / b).cast("int")

    a, b, c = year % 19, div(year, 100), year % 100
    d, e = div(b, 4), b % 4
    g = div(b - div(b + 8, 25) + 1, 3)
    h = (a * 19 + b - d - g + 15) % 30
    i, k = div(c, 4), c % 4
    m = (e * 2 + i * 2 - h - k + 32) % 7
    n = div(a + h * 11 + m * 22, 451)
    total = h + m - n * 7 + 114
    return F.make_date(year, div(total, 31), total % 31 + 1)


def is_holiday(day: Column, include_sundays: bool = False) -> Column:
    """Swedish public holiday test as plain date arithmetic, no lookup table.

    Fixed days; days counted from Easter; Midsummer Eve and Day (Friday/Saturday
    19-26 June); All Saints' Day (Saturday 31 October - 6 November).
    """
    md = F.month(day) * 100 + F.dayofmonth(day)
    off = F.datediff(day, easter_sunday(F.year(day)))
    weekday = F.weekday(day)
    hit = (
        md.isin(101, 106, 501, 1224, 1225, 1226, 1231)
        | ((md == 606) & (F.year(day) >= 2005))
        | off.isin(-2, 0, 1, 39, 49)
        | ((off == 50) & (F.year(day) <= 2004))
        | ((weekday == 4) & md.between(619, 625))
        | ((weekday == 5) & md.between(620, 626))
        | ((weekday == 5) & md.between(1031, 1106))
    )
    if include_sundays:
        hit = hit | (weekday == 6)
    return hit


def wave(fn: str, value: Column, period: float, k: int = 1) -> Column:
    angle = value * F.lit(2.0 * math.pi * k) / F.lit(float(period))
    return F.sin(angle) if fn == "sin" else F.cos(angle)


def calendar_fields(ts: str, tz: str = LOCAL_ZONE) -> dict[str, Column]:
    t = local(ts, tz)
    return {
        "hour": F.hour(t),
        "minute": F.minute(t),
        "dayofweek": F.weekday(t),
        "month": F.month(t),
        "slot": F.hour(t) * 4 + F.floor(F.minute(t) / 15).cast("int"),
        "_doy": F.dayofyear(t),
        "_day": F.to_date(t),
    }


def cyclic(columns: dict[str, float]) -> dict[str, Column]:
    """sin and cos of one turn per period, named ``<short>_sin`` / ``<short>_cos``."""
    short = {"dayofweek": "dow"}
    return {
        f"{short.get(c, c)}_{fn}": wave(fn, F.col(c), period)
        for c, period in columns.items()
        for fn in ("sin", "cos")
    }


def harmonics(slot: Column, slots_per_day: int) -> dict[str, Column]:
    """Daily and weekly harmonics k=1..3 and yearly k=1..2 on the given slot."""
    week = F.col("dayofweek") * slots_per_day + slot
    year = (F.col("_doy") - 1) * slots_per_day + slot
    out: dict[str, Column] = {}
    for name, value, period, top in (
        ("daily", slot, slots_per_day, 3),
        ("weekly", week, 7 * slots_per_day, 3),
        ("annual", year, 365 * slots_per_day, 2),
    ):
        for k in range(1, top + 1):
            for fn in ("sin", "cos"):
                out[f"{name}_{fn}_k{k}"] = wave(fn, value, period, k)
    return out


def flags() -> dict[str, Column]:
    hour, month = F.col("hour"), F.col("month")
    return {
        "season": season(month),
        "is_weekend": (F.col("dayofweek") >= 5).cast("int"),
        "is_holiday": is_holiday(F.col("_day")).cast("int"),
        "is_peak": hour.isin(*PEAK_HOURS).cast("int"),
        "is_night": hour.isin(*NIGHT_HOURS).cast("int"),
        "is_winter": month.isin(*WINTER_MONTHS).cast("int"),
    }
