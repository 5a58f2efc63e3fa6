"""Row windows over dense series: lags, rolling statistics, run lengths.

The ``*_cols`` helpers return window columns for use inside a stage of
``blocks.windowed``; the functions taking a DataFrame are whole operators.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.operators.blocks import (
    BLK,
    POS,
    Series,
    last_known,
    settle,
    spread,
    windowed,
)

_AGG = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
}


def lagged(s: Series, c: str | Column, n: int) -> Column:
    return F.lag(c, n).over(s.over) if n >= 0 else F.lead(c, -n).over(s.over)


def rolled(s: Series, c: str, n: int, agg: str, min_periods: int | None = None) -> Column:
    """Statistic of the last ``n`` rows, NULL unless enough of them hold a value."""
    w = s.frame(-(n - 1))
    return F.when(F.count(c).over(w) >= (min_periods or n), _AGG[agg](c).over(w))


def growing(s: Series, c: str) -> dict[str, Column]:
    """Sum and count from the block's first row on (inputs of ``wide_mean``)."""
    return {
        f"_s_{c}": F.sum(F.coalesce(F.col(c), F.lit(0.0))).over(s.upto),
        f"_n_{c}": F.count(c).over(s.upto),
    }


def wide_mean(s: Series, c: str, n: int, min_periods: int | None = None) -> Column:
    """Mean of the last ``n`` rows as a difference of growing sums: constant work
    per row, where a sliding frame would add up ``n`` values for each."""
    total = F.col(f"_s_{c}") - F.coalesce(F.lag(f"_s_{c}", n).over(s.over), F.lit(0.0))
    count = F.col(f"_n_{c}") - F.coalesce(F.lag(f"_n_{c}", n).over(s.over), F.lit(0))
    return F.when(count >= (min_periods or n), total / F.nullif(count, F.lit(0)))


def lag(df: DataFrame, s: Series, c: str, ns: Sequence[int], name: str | None = None) -> DataFrame:
    name = name or f"{c}_lag"
    reach = max(ns)
    return windowed(
        df, s, [lambda s: {f"{name}_{n}": lagged(s, c, n) for n in ns}], back=max(reach, 0)
    )


def lead(df: DataFrame, s: Series, c: str, h: int, name: str) -> DataFrame:
    return windowed(df, s, [lambda s: {name: lagged(s, c, -h)}], ahead=h)


def rolling(
    df: DataFrame,
    s: Series,
    c: str,
    n: int,
    aggs: Sequence[str],
    min_periods: int | None = None,
    prefix: str | None = None,
    wide: bool = False,
) -> DataFrame:
    """``wide`` takes means from growing sums (constant work per row, whatever ``n``)."""
    prefix = prefix or f"{c}_roll{n}"
    if wide:
        if list(aggs) != ["mean"]:
            raise ValueError("only means can be taken from growing sums")
        stages = [
            lambda s: growing(s, c),
            lambda s: {f"{prefix}_mean": wide_mean(s, c, n, min_periods)},
        ]
        return windowed(df, s, stages, back=n).drop(f"_s_{c}", f"_n_{c}")
    return windowed(
        df,
        s,
        [lambda s: {f"{prefix}_{a}": rolled(s, c, n, a, min_periods) for a in aggs}],
        back=n - 1,
    )


# Weights grow over a block and are centred on 1, so a double holds e**(2 * 650).
EWM_SHIFT = 460.0
EWM_ROWS = 2880
# The means at the starts of a series' blocks: a fold of ``m * mean + add`` over its steps
# in time order, in chunks, as arrays grow by copying.
EWM_STARTS = """flatten(aggregate(
  transform(sequence(0, (size(_steps) - 1) div 256), c -> slice(_steps, c * 256 + 1, 256)),
  named_struct('y', 0D, 'out', cast(array() AS array<array<double>>)),
  (done, chunk) -> transform(array(aggregate(
      chunk, named_struct('y', done.y, 'out', cast(array() AS array<double>)),
      (a, s) -> named_struct('y', s.m * a.y + s.add, 'out', concat(a.out, array(a.y))))),
    r -> named_struct('y', r.y, 'out', concat(done.out, array(r.out))))[0],
  done -> done.out))"""


class Ewm:
    """Recursive exponential mean over gaps of any length, as columns of a cut series.

    At a value the state becomes ``(w*y + a*x) / (w + a)`` where ``w`` has decayed by
    ``1-a`` once per row since the last value, i.e. ``y`` keeps the share ``d`` and
    ``x`` enters with ``1-d``.  With ``D`` the running sum of ``log d`` this unrolls to
    ``exp(D) * sum((1-d) * x * exp(-D))``: two running sums instead of a fold.

    Each block is summed as if the series began with its first own value ``f``.  With the
    mean ``y`` carried in, the first value would keep a share ``d`` of it, so a row is off
    by ``exp(D) * d * (y - f)``.  The carried means follow from one row per block: over a
    block the mean becomes ``m * mean + add``, and such steps compose.

    ``value`` is the column of the series, NULL on rows copied from other blocks.
    """

    def __init__(self, s: Series, value: Column, span: int):
        self.a = 2.0 / (span + 1.0)
        # The whole span of a block must fit the range of a double.
        self.most = min(EWM_ROWS, int(1300 / -math.log(1 - self.a)) - 480)
        self.s, self.x = s, value

    def kept(self, gap: Column) -> Column:
        w = F.pow(F.lit(1.0 - self.a), gap)
        return w / (w + F.lit(self.a))

    def stages(self) -> list[dict[str, Column]]:
        """Window columns, each stage reading the ones before it: ``_e_x``, the mean
        within the block as ``_e_y``, and what links it to the mean carried in."""
        s, x = self.s, F.col("_e_x")
        prev = F.max(F.when(x.isNotNull(), F.col(POS))).over(s.over.rowsBetween(Window.unboundedPreceding, -1))
        keep, first = self.kept(F.col(POS) - F.col("_e_prev")), F.col("_e_prev").isNull()
        log = F.when(x.isNull() | first, F.lit(0.0)).otherwise(F.log(keep))
        gain = F.when(x.isNull(), 0.0).when(first, 1.0).otherwise(1.0 - keep)
        body = F.sum(F.col("_e_gain") * F.coalesce(x, F.lit(0.0)) * F.exp(-F.col("_e_log") - EWM_SHIFT)).over(s.upto)
        return [
            {"_e_x": self.x},
            {"_e_prev": prev},
            {"_e_gain": gain, "_e_log": F.sum(log).over(s.upto)},
            {
                "_e_y": F.when(F.count(x).over(s.upto) > 0, F.exp(F.col("_e_log") + EWM_SHIFT) * body),
                "_e_first": F.first(x, ignorenulls=True).over(s.upto),
            },
        ]

    def tails(self) -> dict[str, Column]:
        """What a block's own rows say about it, one row per (keys, block)."""
        has = F.when(F.col("_e_x").isNotNull(), F.col(POS))
        return {
            "_e_at": F.min(has),
            "_e_to": F.max(has),
            "_b_y": F.max_by("_e_y", has),
            "_b_log": F.max_by("_e_log", has),
            "_b_first": F.min_by("_e_x", has),
        }

    def carried(self, blocks: DataFrame) -> DataFrame:
        """``blocks`` (with ``tails``) with the mean carried in as ``_e_in`` and the slot of
        its last value as ``_e_from``; the fold has one step per block of a series."""
        keys = list(self.s.keys)
        before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
        out = blocks.withColumn("_e_from", F.last("_e_to", ignorenulls=True).over(before))
        share = F.exp("_b_log") * self.kept(F.col("_e_at") - F.col("_e_from"))
        m = F.when(F.col("_e_at").isNull(), 1.0).when(F.col("_e_from").isNull(), 0.0).otherwise(share)
        add = F.expr("if(_e_at IS NULL, 0D, _b_y - _m * coalesce(_b_first, 0D))")
        rest = [c for c in blocks.columns if c not in (*keys, "_e_to", "_b_y", "_b_log", "_b_first")]
        rows = out.withColumn("_m", m).groupBy(*keys).agg(
            F.sort_array(F.collect_list(F.struct(*rest, "_e_from", F.col("_m").alias("m"), add.alias("add")))).alias("_steps")
        )
        each = rows.select(*keys, F.explode(F.arrays_zip(F.col("_steps").alias("s"), F.expr(EWM_STARTS).alias("y"))).alias("_b"))
        start = F.when(F.col("_b.s._e_from").isNotNull(), F.col("_b.y"))
        return each.select(*keys, *[F.col(f"_b.s.{c}").alias(c) for c in (*rest, "_e_from")], start.alias("_e_in"))

    def mean(self, y: Column, log: Column, first: Column) -> Column:
        """The mean at a row from its block's mean, log share and first value there."""
        late = y + F.exp(log) * self.kept(F.col("_e_at") - F.col("_e_from")) * (F.col("_e_in") - first)
        return F.when(y.isNull(), F.col("_e_in")).when(F.col("_e_in").isNull(), y).otherwise(late)


EWM_COLUMNS = ("_e_x", "_e_prev", "_e_gain", "_e_log", "_e_y", "_e_first", "_e_in", "_e_from", "_e_at")


def ewm(df: DataFrame, s: Series, c: str, name: str, span: int = 8) -> DataFrame:
    """Recursive exponential mean of ``c`` (see ``Ewm``)."""
    e = Ewm(s, F.col(c), span)
    s = s.cut(min(s.rows, e.most))
    e.s = s
    cut = spread(df, s)
    for stage in e.stages():
        cut = cut.withColumns(stage)
    blocks = cut.groupBy(*s.keys, BLK).agg(*[x.alias(n) for n, x in e.tails().items()])
    out = cut.join(e.carried(blocks), [*s.keys, BLK], "left")
    value = e.mean(F.col("_e_y"), F.col("_e_log"), F.col("_e_first"))
    return settle(out.withColumn(name, value), s).drop(*EWM_COLUMNS)


def seasonal_mean(
    df: DataFrame, s: Series, c: str, weights: Mapping[int, float], name: str
) -> DataFrame:
    """Weighted mean of lags; NULL if any of them is."""
    total = lambda s: sum(
        (lagged(s, c, n) * F.lit(w) for n, w in weights.items()), start=F.lit(0.0)
    )
    return windowed(df, s, [lambda s: {name: total(s)}], back=max(weights))


def differs(a: Column, b: Column) -> Column:
    """Inequality in which a missing side always differs."""
    return F.coalesce(a != b, F.lit(True))


def run_columns(df: DataFrame, s: Series, back: int, changes: Mapping[str, Column]) -> DataFrame:
    """Rows since the last change, from 1: one column per change flag.

    ``df`` carries POS and BLK with a halo of ``back`` rows for the flags.
    """
    marks = {n: F.when(c, F.col(POS)) for n, c in changes.items()}
    out = last_known(df, s, marks)
    return out.withColumns({n: F.col(POS) - F.col(n) + 1 for n in changes}).drop("_origin")


def streak(df: DataFrame, s: Series, c: str, name: str, shift: int = 1) -> DataFrame:
    """Run length of the lagged value, starting at 1."""
    cut = spread(df, s, back=shift + 1)
    cut = cut.withColumns({"_c1": lagged(s, c, shift), "_c2": lagged(s, c, shift + 1)})
    own = cut.where(F.col(BLK) == s.home)
    out = run_columns(own, s, 0, {name: differs(F.col("_c1"), F.col("_c2"))})
    return out.drop("_c1", "_c2", POS, BLK)


def run_position(df: DataFrame, s: Series, flag: Column, name: str, shift: int = 0) -> DataFrame:
    """0-based position within a run of the flag, 0 outside of runs."""
    cut = spread(df.withColumn("_f0", F.coalesce(flag, F.lit(False))), s, back=shift + 1)
    # Before the series starts the lagged flag counts as not set.
    now = F.coalesce(lagged(s, "_f0", shift), F.lit(False)) if shift else F.col("_f0")
    cut = cut.withColumn("_f1", now)
    cut = cut.withColumn("_f2", lagged(s, "_f1", 1))
    own = cut.where(F.col(BLK) == s.home)
    out = run_columns(own, s, 0, {name: differs(F.col("_f1"), F.col("_f2"))})
    out = out.withColumn(name, F.when(F.col("_f1"), F.col(name) - 1).otherwise(F.lit(0)))
    return out.drop("_f0", "_f1", "_f2", POS, BLK)


def since_last(df: DataFrame, s: Series, flag: Column, name: str, shift: int = 0) -> DataFrame:
    """Rows since the flag was last set; counts from the series start if it never was."""
    cut = spread(df.withColumn("_f0", F.coalesce(flag, F.lit(False))), s, back=shift)
    cut = cut.withColumn("_f1", lagged(s, "_f0", shift) if shift else F.col("_f0"))
    own = cut.where(F.col(BLK) == s.home)
    out = last_known(own, s, {name: F.when(F.col("_f1"), F.col(POS))})
    count = F.col(POS) - F.coalesce(F.col(name), F.col("_origin") - 1)
    return out.withColumn(name, count).drop("_f0", "_f1", "_origin", POS, BLK)


def flip_counts(df: DataFrame, s: Series, c: str, ns: Sequence[int], shift: int = 1) -> DataFrame:
    """Changes of the lagged value within the last n rows, NULL before n rows exist."""
    stages = [
        lambda s: {"_c1": lagged(s, c, shift), "_c2": lagged(s, c, shift + 1)},
        lambda s: {"_flip": differs(F.col("_c1"), F.col("_c2")).cast("int")},
        lambda s: {f"flips_{n}": rolled(s, "_flip", n, "sum") for n in ns},
    ]
    return windowed(df, s, stages, back=shift + max(ns)).drop("_c1", "_c2", "_flip")


def flip_to(df: DataFrame, s: Series, c: str, now: int, before: int, name: str) -> DataFrame:
    hit = lambda s: (lagged(s, c, 1) == now) & (lagged(s, c, 2) == before)
    return windowed(
        df, s, [lambda s: {name: F.coalesce(hit(s), F.lit(False)).cast("int")}], back=2
    )


def momentum(df: DataFrame, s: Series, c: str, a: int, b: int, name: str) -> DataFrame:
    return windowed(df, s, [lambda s: {name: lagged(s, c, a) - lagged(s, c, b)}], back=b)


def zscore(df: DataFrame, s: Series, c: str, n: int, name: str, eps: float = 1e-6) -> DataFrame:
    return windowed(
        df,
        s,
        [lambda s: {name: (F.col(c) - rolled(s, c, n, "mean")) / (rolled(s, c, n, "std") + eps)}],
        back=n - 1,
    )


def anomaly(df: DataFrame, s: Series, c: str, n: int = 168, k: float = 2.0) -> DataFrame:
    """Each value against the mean and spread of the last n rows (itself included)."""
    from gridtide.functions.scalars import zscore_class

    w = lambda s: s.frame(-(n - 1))
    stages = [
        lambda s: {"mean_n": F.avg(c).over(w(s)), "std_n": F.stddev_samp(c).over(w(s))},
        lambda s: {
            "z_score": F.when(
                F.col("std_n") > 0, (F.col(c) - F.col("mean_n")) / F.col("std_n")
            ).otherwise(F.lit(0.0))
        },
        lambda s: {"anomaly": zscore_class("z_score", k)},
    ]
    return windowed(df, s, stages, back=n - 1)


def shortfall(df: DataFrame, s: Series, c: str, n: int, name: str) -> DataFrame:
    return windowed(df, s, [lambda s: {name: rolled(s, c, n, "max") - F.col(c)}], back=n - 1)


def trailing(df: DataFrame, s: Series, c: str, n: int, aggs: Sequence[str]) -> DataFrame:
    """Statistics of up to n rows strictly before the row."""
    w = lambda s: s.frame(-n, -1)
    return windowed(
        df, s, [lambda s: {f"{c}_tail{n}_{a}": _AGG[a](c).over(w(s)) for a in aggs}], back=n
    )


def near(df: DataFrame, s: Series, flag: Column, k: int = 2, name: str = "near") -> DataFrame:
    """Whether a flagged row lies within k rows on either side."""
    f = F.coalesce(flag, F.lit(False)).cast("int")
    return windowed(df, s, [lambda s: {name: F.max(f).over(s.frame(-k, k))}], back=k, ahead=k)


def step_agreement(df: DataFrame, s: Series, a: str, b: str, name: str) -> DataFrame:
    """Whether two series step in the same direction; NULL on the first row."""
    step = lambda s, c: F.sign(F.col(c) - lagged(s, c, 1))
    return windowed(
        df, s, [lambda s: {name: (step(s, a) == step(s, b)).cast("int")}], back=1
    )


def segments(df: DataFrame, s: Series, label: str) -> DataFrame:
    """Contiguous slots of equal label as (keys, start, end, label, slots).

    A missing slot ends a segment, whatever the labels on its two sides.  A row's segment
    is named by the slot of its first row, which the run length gives; the last, still
    open segment is included.
    """
    cut = spread(df.select(*s.keys, s.ts, label), s, back=1)
    cut = cut.withColumns({"_before": lagged(s, label, 1), "_gap": F.col(POS) - lagged(s, POS, 1)})
    own = cut.where(F.col(BLK) == s.home)
    joined = F.col(label).eqNullSafe(F.col("_before")) & F.coalesce(F.col("_gap") == 1, F.lit(False))
    out = run_columns(own, s, 0, {"_run": ~joined})
    seg = F.col(POS) - F.col("_run") + 1
    return (
        out.groupBy(*s.keys, seg.alias("_seg"), label)
        .agg(F.min(s.ts).alias("start"), F.max(s.ts).alias("end"), F.count(F.lit(1)).alias("slots"))
        .drop("_seg")
    )


def same_hour_mean(df: DataFrame, s: Series, c: str, days: int, name: str) -> DataFrame:
    per_day = 86400 // s.step
    total = lambda s: sum(
        (lagged(s, c, per_day * d) for d in range(1, days + 1)), start=F.lit(0.0)
    ) / F.lit(days)
    return windowed(df, s, [lambda s: {name: total(s)}], back=per_day * days)
