"""Wide training frames built from the stored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.operators.blocks import BLK, HOURLY, POS, QUARTER, Series, attach, carry_last, spread
from gridtide.operators.grid import densify, ffill, fill_median, grid_slots, overlay, resample


#: Rows of the grid itself come after the rows of all sources at the same slot.
_GRID = 1_000_000


def master_frame(
    imbalance: DataFrame,
    sources: Mapping[str, DataFrame],
    s: Series = QUARTER,
    limit: int | None = 4,
    dense: bool = True,
    limits: Mapping[str, int | None] | None = None,
    live: DataFrame | None = None,
) -> DataFrame:
    """Imbalance rows with every other source at their slot, by one sweep over all.

    A source's value holds for its own slot and, up to its last row, for ``limit`` slots
    after (``limits``: other limits by source name, None for no limit).  The columns of
    ``live`` stand in where the source of that name has nothing.

    Rows of all sources are tagged and united with the slots of the grid, exchanged once
    and sorted once; per column the last value is carried along with its slot.  The ends
    of the sources come with the grid, from one row per series.  Rows off the grid are
    dropped; of several rows of a source at one slot the values of any one are taken.
    """
    named = {n: df.withColumnsRenamed({"price_eur_mwh": "spot_price"}) for n, df in sources.items()}
    reach = {n: (limits or {}).get(n, limit) for n in named}
    if live is not None:
        cols = [c for c in live.columns if c not in (*s.keys, s.ts)]
        named["_live"] = live.withColumnsRenamed({c: f"_live_{c}" for c in cols})
        reach["_live"] = (limits or {}).get("_live", limit)
    parts = [imbalance, *named.values()]
    columns = [[c for c in df.columns if c not in (*s.keys, s.ts)] for df in parts]

    def tagged(k: int, df: DataFrame) -> DataFrame:
        on_grid = df.withColumn(POS, s.position()).where(s.time_of(F.col(POS)) == F.col(s.ts))
        return on_grid.select(*s.keys, POS, F.lit(k).alias("_src"), *columns[k])

    rows = [tagged(k, df) for k, df in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    ends = both.groupBy(*s.keys).agg(
        F.min(F.when(F.col("_src") == 0, F.col(POS))).alias("_lo"),
        *[F.max(F.when(F.col("_src") == k, F.col(POS))).alias(f"_end_{k}") for k in range(len(parts))],
    )
    last = [f"_end_{k}" for k in range(1, len(parts))]
    if dense:
        spans = ends.where(F.col("_lo").isNotNull())
        slots = grid_slots(spans, s, "_lo", "_end_0", last).withColumn(POS, s.position()).drop(s.ts)
    else:
        slots = attach(rows[0].select(*s.keys, POS).distinct(), ends.select(*s.keys, *last), s.keys)
    united = both.unionByName(slots.withColumn("_src", F.lit(_GRID)), allowMissingColumns=True)

    halo = max([n for n in reach.values() if n is not None], default=0)
    cut = spread(united.withColumn(s.ts, s.time_of(F.col(POS))), s, back=halo)
    seen = Window.partitionBy(*s.keys, BLK).orderBy(POS, "_src").rowsBetween(Window.unboundedPreceding, 0)
    mark = lambda c: F.expr(f"if(`{c}` IS NULL, NULL, struct({POS} AS at, `{c}` AS v))")
    endless = [c for n, cs in zip(named, columns[1:]) if reach[n] is None for c in cs]
    held = [F.last(mark(c), ignorenulls=True).over(seen).alias(f"_v_{c}") for cs in columns for c in cs]
    out = cut.select(*s.keys, s.ts, POS, BLK, "_src", *last, *held)
    if endless:
        carry = carry_last(cut, s, {f"_in_{c}": mark(c) for c in endless}).drop("_origin")
        out = out.join(carry, [*s.keys, BLK], "left")
    out = out.where((F.col("_src") == _GRID) & (F.col(BLK) == s.home))

    def value(k: int, c: str, most: int | None) -> Column:
        x = f"coalesce(`_v_{c}`, `_in_{c}`)" if c in endless else f"`_v_{c}`"
        near = "true" if most is None else f"{POS} - {x}.at <= {most}"
        until = f"{POS} <= _end_{k}" if k else "true"
        return F.expr(f"if({near} AND {until}, {x}.v, NULL)")

    found = {c: value(0, c, 0) for c in columns[0]}
    for k, n in enumerate(named, start=1):
        found |= {c: value(k, c, reach[n]) for c in columns[k]}
    if live is not None:
        for c in columns[-1]:
            own = found.get(plain := c.removeprefix("_live_"))
            found[plain] = found.pop(c) if own is None else F.coalesce(own, found.pop(c))
    return out.select(*s.keys, s.ts, *[x.alias(c) for c, x in found.items()])


def with_live_forecast(master: DataFrame, live: DataFrame, s: Series = QUARTER) -> DataFrame:
    """Fill forecast columns from a second, live source where the first has none."""
    cols = [c for c in live.columns if c not in (*s.keys, s.ts)]
    return overlay(master, live, [*s.keys, s.ts], cols)


def hourly_imbalance(imbalance: DataFrame, s: Series = HOURLY) -> DataFrame:
    """Quarter-hour imbalance averaged to hours."""
    cols = [c for c in imbalance.columns if c not in (*s.keys, s.ts)]
    return resample(imbalance, s, {c: F.avg(c) for c in cols})


def spot_frame(
    prices: DataFrame,
    weather: DataFrame,
    generation: DataFrame | None = None,
    nuclear: DataFrame | None = None,
    flows: DataFrame | None = None,
    imbalance: DataFrame | None = None,
    forecasts: Sequence[DataFrame] = (),
    median_cols: Sequence[str] = (),
    s: Series = HOURLY,
) -> DataFrame:
    """Prices with weather (inner), then generation, nuclear, flows, hourly imbalance
    and forecasts (left); nuclear and flows are filled 3 rows, listed columns by median."""
    on = [*s.keys, s.ts]
    out = densify(prices.join(weather, on), s)
    if generation is not None:
        out = out.join(generation, on, "left")
    filled = []
    for df in (nuclear, flows):
        if df is not None:
            out = out.join(df, on, "left")
            filled += [c for c in df.columns if c not in on]
    if filled:
        out = ffill(out, s, filled, limit=3)
    if imbalance is not None:
        out = out.join(hourly_imbalance(imbalance, s), on, "left")
    for df in forecasts:
        out = out.join(df, on, "left")
    return fill_median(out, median_cols) if median_cols else out


def generation_view(generation: DataFrame, nuclear: DataFrame, on: Sequence[str] = ("zone", "ts")) -> DataFrame:
    return generation.join(nuclear, list(on), "left")


def weather_view(
    weather: DataFrame,
    optional: Mapping[str, tuple[DataFrame | None, Sequence[str]]],
    on: Sequence[str] = ("zone", "ts"),
) -> DataFrame:
    """Weather with the columns of optional tables, NULL where a table is missing."""
    out = weather
    for df, cols in optional.values():
        if df is None:
            out = out.withColumns({c: F.lit(None).cast("double") for c in cols})
        else:
            out = out.join(df.select(*on, *cols), list(on), "left")
    return out
