"""Training and forecasting plans for many series and many run times at once."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtide.features import imbalance as fi
from gridtide.features import spot as fs
from gridtide.features.matrix import Matrix
from gridtide.functions import calendar as cal
from gridtide.functions.scalars import regime
from gridtide.models import linear
from gridtide.models.quantile import MISSING, QuantileForest, fit_quantiles, leaf_of, node_tables
from gridtide.models.spike import SpikeModel, fit_spike
from gridtide.models.splits import CORE_LAGS, tail_fraction, time_split
from gridtide.operators.blocks import HOURLY, QUARTER, Series, attach
from gridtide.operators.grid import ffill, future_grid
from gridtide.operators.joins import latest_before, nearest, run_history
from gridtide.operators.projections import known_columns
from gridtide.plans import evaluate
from gridtide.session import materialize

SPOT_CORE = ("price_roll_720h_mean", "price_roll_168h_mean", "price_lag_168h")

# --- day-ahead -----------------------------------------------------------------


@dataclass
class SpotModel:
    """Neutraliser, linear baseline and quantile forest on what the baseline leaves."""

    features: list[str]
    neutralizer: linear.Ridge
    baseline: linear.Ridge
    forest: QuantileForest
    recent: QuantileForest | None = None

    def predict(self, feats: DataFrame) -> DataFrame:
        """Add baseline and p05/p50/p95 to a feature frame."""
        x = linear.neutralize(feats, self.neutralizer)
        x = x.withColumn("baseline", self.baseline.explained("price_eur_mwh"))
        out = self.forest.transform(x)
        shift = F.col("baseline")
        if self.recent is not None:
            # The second stage models what the first one's median leaves.
            out = self.recent.transform(out.withColumnRenamed("p50", "_first").drop("p05", "p95"))
            shift = shift + F.col("_first")
        out = out.withColumns({q: F.col(q) + shift for q in ("p05", "p50", "p95")})
        return out.drop("_first")

    def save(self, path: str) -> None:
        self.forest.save(f"{path}/forest")
        if self.recent is not None:
            self.recent.save(f"{path}/recent")
        config = {
            "features": self.features, "neutralizer": linear.to_config(self.neutralizer),
            "baseline": linear.to_config(self.baseline), "recent": self.recent is not None,
        }
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(config),)], "config string").write.mode("overwrite").json(f"{path}/config")

    @classmethod
    def load(cls, path: str) -> "SpotModel":
        spark = SparkSession.active()
        try:
            text = spark.read.schema("config string").json(f"{path}/config").first()["config"]
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            raise FileNotFoundError(f"no saved model under {path}; train one first") from exc
        c = json.loads(text)
        return cls(
            c["features"], linear.from_config(c["neutralizer"]), linear.from_config(c["baseline"]),
            QuantileForest.load(f"{path}/forest"),
            QuantileForest.load(f"{path}/recent") if c["recent"] else None,
        )


def fit_spot(
    feats: DataFrame, s: Series = HOURLY, test_days: int = 90, core: Sequence[str] = SPOT_CORE,
    trees: int = 20, depth: int = 6,
) -> tuple[SpotModel, DataFrame]:
    """Model and the frame of held-out rows it was not trained on."""
    # Several fits read these rows, so they are written once.
    rows = materialize(time_split(feats.dropna(subset=["price_eur_mwh", *core]), test_days, s.keys, s.ts))
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    wanted = fs.feature_list(feats.columns)
    features = fs.feature_list(feats.columns, known_columns(rows, wanted))
    neutral = linear.fit_neutralizer(train, features)
    flat = linear.neutralize(train, neutral)
    base = linear.fit_baseline(flat, "price_eur_mwh")
    resid = materialize(tail_fraction(linear.with_baseline(flat, base, "price_eur_mwh"), s, 0.1))
    forest = fit_quantiles(
        resid.where("not valid"), features, "residual", resid.where("valid"), trees=trees, depth=depth
    )
    return SpotModel(features, neutral, base, forest), test.drop("part")


def pretrain_spot(feats: DataFrame, s: Series = HOURLY, cutoff_days: int = 180, **fit) -> tuple[SpotModel, DataFrame]:
    """Train on the rows older than the cutoff only."""
    old = time_split(feats, cutoff_days, s.keys, s.ts).where("part = 'train'").drop("part")
    return fit_spot(old, s, **fit)


def posttrain_spot(
    model: SpotModel, feats: DataFrame, s: Series = HOURLY, window_days: int = 90,
    trees: int = 10, depth: int = 4, least_rows: int = 48,
) -> SpotModel:
    """Adapt to the recent window: new baseline, frozen neutraliser and first stage,
    and a second forest on what the first stage leaves there."""
    recent = time_split(feats.dropna(subset=["price_eur_mwh"]), window_days, s.keys, s.ts)
    recent = materialize(recent.where("part = 'test'").drop("part"))
    n = recent.count()
    if n < least_rows:
        raise ValueError(f"only {n} recent rows, {least_rows} needed")
    flat = linear.neutralize(recent, model.neutralizer)
    base = linear.fit_baseline(flat, "price_eur_mwh", model.baseline.basis)
    left = linear.with_baseline(flat, base, "price_eur_mwh")
    left = model.forest.transform(left).withColumn("residual", F.col("residual") - F.col("p50"))
    left = materialize(tail_fraction(left.drop("p05", "p50", "p95"), s, 0.15, 24))
    second = fit_quantiles(
        left.where("not valid"), model.features, "residual", left.where("valid"), trees=trees, depth=depth
    )
    return SpotModel(model.features, model.neutralizer, base, model.forest, second)


def forecast_spot(
    hist: DataFrame, weather_fc: DataFrame, model: SpotModel, s: Series = HOURLY, n: int = 24
) -> DataFrame:
    """The next n hours of each series.

    Future rows are appended to the history and run through the very feature plan used
    for training: prices, generation and flows enter lagged by a day or more, weather
    comes from the nearest forecast hour.
    """
    weather = [c for c in weather_fc.columns if c not in (*s.keys, s.ts)]
    slots = future_grid(hist, s, n)
    future = nearest(slots, weather_fc, weather, s.keys, s.ts)
    both = hist.withColumn("_future", F.lit(False)).unionByName(
        future.withColumn("_future", F.lit(True)), allowMissingColumns=True
    )
    feats = fs.spot_features(both, s).where("_future")
    return model.predict(feats).select(*s.keys, s.ts, "p05", "p50", "p95")


# --- imbalance -------------------------------------------------------------------

# Features that move along the forecast path; all others keep their last value.
PATH_FEATURES = [
    *[f"imbl_lag_{n}" for n in (1, 2, 4, 8, 16)], "imbl_lag_1h", "imbl_lag_2h", "imbl_lag_4h",
    "imbl_roll_1h_mean", "imbl_roll_1h_std", "imbl_roll_4h_mean", "imbl_roll_4h_std",
    "imbl_roll_1d_mean", "imbl_ewa",
]
MEMORY = 96


def _known_features(rows: DataFrame, mode: str, known: set[str] | None) -> list[str]:
    """Features of a mode that hold any value in the rows to train on."""
    if known is None:
        known = known_columns(rows, fi.feature_list(rows.columns, mode))
    return fi.feature_list(rows.columns, mode, known)


def fit_imbalance(
    feats: DataFrame, s: Series = QUARTER, test_days: int = 60, known: set[str] | None = None,
    trees: int = 20, depth: int = 6, label: str = "target_price",
) -> tuple[QuantileForest, DataFrame]:
    rows = time_split(feats.dropna(subset=[label, *CORE_LAGS]), test_days, s.keys, s.ts)
    rows = materialize(rows)
    train = materialize(tail_fraction(rows.where("part = 'train'"), s, 0.1))
    features = _known_features(train, "regression", known)
    model = fit_quantiles(
        train.where("not valid"), features, label, train.where("valid"), trees=trees, depth=depth
    )
    return model, rows.where("part = 'test'").drop("part")


def score_imbalance(model: QuantileForest, test: DataFrame, label: str = "target_price") -> DataFrame:
    out = model.transform(test)
    return out.withColumns({"y": F.col(label), "lag1": F.col("imbl_lag_1")})


def fit_spike_model(
    feats: DataFrame, s: Series = QUARTER, test_days: int = 60, known: set[str] | None = None,
    rounds: int = 20, least: int = 1000,
) -> tuple[SpikeModel, DataFrame]:
    """Classifier with its most profitable threshold on the held-out rows."""
    rows = feats.dropna(subset=["target_binary", "target_price", *CORE_LAGS])
    rows = materialize(time_split(rows, test_days, s.keys, s.ts))
    features = _known_features(rows, "spike", known)
    model = fit_spike(rows.where("part = 'train'"), features, s, rounds=rounds, least=least)
    scored = materialize(model.transform(rows.where("part = 'test'").drop("part")))
    curve = evaluate.profit_curve(scored, "spike_proba", "target_binary", "target_price")
    model.threshold = float(evaluate.profit_threshold(curve).first()["threshold"] or model.threshold)
    return model, scored


def calendar_features(df: DataFrame, s: Series = QUARTER, tz: str = cal.LOCAL_ZONE) -> DataFrame:
    """The calendar columns for given times."""
    m = Matrix(df, s, back=0)
    fi.calendar(m, tz)
    return m.build()


def last_valid_rows(feats: DataFrame, runs: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """Per (keys, run): ``last_ts`` and the features of the newest complete row at or
    before the run time, however old; runs before any complete row have none."""
    rows = feats.where(F.col("imbl_roll_1h_mean").isNotNull())
    which = latest_before(runs.select(*s.keys, "generated_at"), rows, s.keys, "generated_at", s.ts, "last_ts")
    frozen = rows.select(
        *s.keys, F.col(s.ts).alias("last_ts"), F.array(*[F.col(c).cast("double") for c in cols]).alias("frozen")
    )
    return which.where("last_ts IS NOT NULL").join(frozen, [*s.keys, "last_ts"])


def _before_last(hist: DataFrame, last: DataFrame, s: Series, cols: Sequence[str], slots: int) -> DataFrame:
    """History of each run: the slots up to its last complete row (``last_ts``).  Runs
    that end at the same row share one copy until they are told apart."""
    near = run_history(
        hist.select(*s.keys, s.ts, *cols), last.select(*s.keys, "last_ts"), slots * s.step, s.keys, s.ts, "last_ts"
    )
    return near.join(last.select(*s.keys, "generated_at", "last_ts"), [*s.keys, "last_ts"])


def run_states(hist: DataFrame, feats: DataFrame, runs: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """One row per (keys, run): frozen features, the last 96 prices up to its last
    complete row, oldest first, and the exponential mean there."""
    last = last_valid_rows(feats, runs, s, [*cols, "imbl_ewa", "imbl_lag_1"])
    rows = _before_last(hist, last, s, ["imbl_price"], MEMORY)
    age = ((F.unix_seconds("last_ts") - F.unix_seconds(s.ts)) / s.step).cast("int")
    # At most 96 slots per run.
    path = rows.groupBy(*s.keys, "generated_at").agg(
        F.sort_array(F.collect_list(F.struct((-age).alias("a"), F.col("imbl_price").alias("p")))).alias("_path")
    )
    return last.join(path.select(*s.keys, "generated_at", F.col("_path.p").alias("prices")), [*s.keys, "generated_at"])


def _step_features(mem: np.ndarray, ewa: np.ndarray) -> dict[str, np.ndarray]:
    """Path features of the next slot from the price memory (newest last), by the same
    definitions as in training."""
    tail = lambda n: mem[:, -n:]
    out = {f"imbl_lag_{n}": mem[:, -n] for n in (1, 2, 4, 8, 16)}
    out |= {"imbl_lag_1h": mem[:, -4], "imbl_lag_2h": mem[:, -8], "imbl_lag_4h": mem[:, -16]}
    for name, n in (("1h", 4), ("4h", 16)):
        out[f"imbl_roll_{name}_mean"] = tail(n).mean(axis=1)
        out[f"imbl_roll_{name}_std"] = tail(n).std(axis=1, ddof=1)
    out["imbl_roll_1d_mean"] = tail(96).mean(axis=1)
    out["imbl_ewa"] = ewa
    return out


def forecast_recursive(
    hist: DataFrame, feats: DataFrame, model: QuantileForest, runs: DataFrame,
    s: Series = QUARTER, n: int = MEMORY, tz: str = cal.LOCAL_ZONE,
) -> DataFrame:
    """n steps ahead for every (keys, run), feeding each median back into the lags.

    Runs are independent, so they are spread over the cluster; within a task all runs
    of a batch advance together, one matrix per step.  What does not change along the
    path (frozen features, the calendar of the coming slots) is prepared by Spark.
    """
    feature_names = model.features
    calendar_names = [c for c in fi.CALENDAR if c in feature_names]
    states = run_states(hist, feats, runs, s, feature_names)
    slots = states.select(
        *s.keys, "generated_at",
        F.posexplode(F.sequence(F.lit(1), F.lit(n))).alias("_i", "_k"), "last_ts",
    ).withColumn(s.ts, F.timestamp_seconds(F.unix_seconds("last_ts") + F.col("_k") * s.step))
    cals = calendar_features(slots, s, tz).select(
        *s.keys, "generated_at", "_k", F.array(*[F.col(c).cast("double") for c in calendar_names]).alias("_c")
    )
    ahead = cals.groupBy(*s.keys, "generated_at").agg(
        F.flatten(F.sort_array(F.collect_list(F.struct("_k", "_c")))["_c"]).alias("calendar")
    )
    batch = states.join(ahead, [*s.keys, "generated_at"])
    known = hist.sparkSession.sparkContext.broadcast((node_tables(model), model.table))  # bounded by the forest's shape
    alphas, trees = list(model.alphas.values()), model.trees
    depth = model.forest.getOrDefault("maxDepth")
    position = {c: i for i, c in enumerate(feature_names)}
    decay = 7.0 / 9.0
    key_cols = [*s.keys, "generated_at", "last_ts"]

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, table = known.value
        for b in batches:
            if b.empty:
                continue
            frozen = np.array(b["frozen"].tolist(), dtype=float)
            x, ewa_lag, lag1 = frozen[:, :-2].copy(), frozen[:, -2], frozen[:, -1]
            mem = np.full((len(b), MEMORY), np.nan)
            for r, path in enumerate(b["prices"]):
                p = np.array(path, dtype=float)
                mem[r, MEMORY - len(p):] = p
            # A complete row has known prices just before it, so no path is empty.
            mem = pd.DataFrame(mem).ffill(axis=1).bfill(axis=1).to_numpy()
            # The stored mean ends one slot before the last row; take that row in.
            ewa = decay * np.where(np.isnan(ewa_lag), mem[:, -1], ewa_lag) + (1 - decay) * mem[:, -1]
            coming = np.array(b["calendar"].tolist(), dtype=float).reshape(len(b), n, len(calendar_names))
            for k in range(n):
                for c, v in _step_features(mem, ewa).items():
                    if c in position:
                        x[:, position[c]] = v
                for j, c in enumerate(calendar_names):
                    x[:, position[c]] = coming[:, k, j]
                if k and "dir_lag_1" in position:
                    x[:, position["dir_lag_1"]] = np.sign(mem[:, -1])
                filled = np.where(np.isnan(x), MISSING, x)
                hit = np.stack([leaf_of(filled, t, depth) for t in tables], axis=1)
                q = table.quantiles(hit, alphas, trees).T
                mem = np.concatenate([mem[:, 1:], q[1][:, None]], axis=1)
                ewa = decay * ewa + (1 - decay) * q[1]
                out = b[key_cols].copy()
                out["step"] = k + 1
                out["p05"], out["p50"], out["p95"] = q
                yield out

    schema = ", ".join(f"{k} string" for k in s.keys)
    schema += ", generated_at timestamp, last_ts timestamp, step int, p05 double, p50 double, p95 double"
    path = batch.mapInPandas(advance, schema)
    at = F.timestamp_seconds(F.unix_seconds("last_ts") + F.col("step") * s.step)
    return path.select(*s.keys, "generated_at", at.alias(s.ts), "step", "p05", "p50", "p95")


def _last_state(hist: DataFrame, runs: DataFrame, s: Series) -> DataFrame:
    """Newest known price and direction per run, from all of its history."""
    out = runs.select(*s.keys, "generated_at").distinct()
    for c, name in (("imbl_price", "last_price"), ("direction", "last_direction")):
        known = hist.where(F.col(c).isNotNull()).select(*s.keys, F.col(s.ts).alias("_at"), F.col(c).alias(name))
        which = latest_before(out, known, s.keys, "generated_at", "_at", "_at")
        found = which.join(known, [*s.keys, "_at"]).drop("_at")
        out = out.join(found, [*s.keys, "generated_at"], "left")
    return out


def _unpack(frozen: str, names: Sequence[str]) -> dict[str, Column]:
    return {c: F.get(F.col(frozen), F.lit(i)) for i, c in enumerate(names)}


def forecast_spike(
    hist: DataFrame, feats: DataFrame, model: SpikeModel, runs: DataFrame, s: Series = QUARTER,
    n: int = MEMORY, tz: str = cal.LOCAL_ZONE,
) -> DataFrame:
    """Spike probability and regime for the next n slots: the last complete row with
    the calendar of each slot."""
    last = last_valid_rows(feats, runs, s, model.features)
    slots = last.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    slots = slots.withColumn(s.ts, F.timestamp_seconds(F.unix_seconds("last_ts") + F.col("_k") * s.step))
    still = [c for c in model.features if c not in fi.CALENDAR]
    values = _unpack("frozen", model.features)
    rows = calendar_features(slots.withColumns({c: values[c] for c in still}), s, tz)
    return _label(model.transform(rows), hist, runs, s)


def forecast_spike_path(
    fc: DataFrame, hist: DataFrame, feats: DataFrame, model: SpikeModel, runs: DataFrame,
    s: Series = QUARTER, tz: str = cal.LOCAL_ZONE,
) -> DataFrame:
    """Spike probability along a known price path: history and path are one series per
    run, so lags and rolling values are plain windows and nothing is recursive."""
    per_run = Series(keys=(*s.keys, "generated_at"), ts=s.ts, step=s.step, rows=s.rows)
    last = last_valid_rows(feats, runs, s, model.features)
    past = _before_last(hist, last, s, ["imbl_price"], 2 * MEMORY).drop("last_ts")
    path = fc.select(*per_run.keys, s.ts, F.col("p50").alias("imbl_price"), F.lit(True).alias("_ahead"))
    starts = fc.groupBy(*per_run.keys).agg(F.min(s.ts).alias("_start"))
    past = past.join(starts, list(per_run.keys)).where(F.col(s.ts) < F.col("_start")).drop("_start")
    both = past.withColumn("_ahead", F.lit(False)).unionByName(path)
    # Several passes follow over the runs' own short series.
    both = materialize(ffill(both, per_run, ["imbl_price"], limit=MEMORY), "path")
    m = Matrix(both, per_run, back=fi.REACH)
    fi.price_lags(m)
    fi.price_rolls(m)
    fi.calendar(m, tz)
    moving = m.build().where("_ahead").drop("_ahead", "imbl_price")
    still = [c for c in model.features if c not in fi.CALENDAR and c not in PATH_FEATURES]
    values = _unpack("frozen", model.features)
    frozen = last.select(*per_run.keys, *[values[c].alias(c) for c in still])
    rows = moving.join(frozen, list(per_run.keys))
    return _label(model.transform(rows), hist, runs, s)


def live_forecast(
    hist: DataFrame, feats: DataFrame, price_model: QuantileForest, spike_model: SpikeModel, s: Series = QUARTER,
    n: int = MEMORY, tz: str = cal.LOCAL_ZONE,
) -> DataFrame:
    """Prices and spike probabilities from the newest row of each series on; slots that
    only one of the two models covers are left out."""
    runs = hist.groupBy(*s.keys).agg(F.max(s.ts).alias("generated_at"))
    prices = forecast_recursive(hist, feats, price_model, runs, s, n, tz)
    spikes = forecast_spike(hist, feats, spike_model, runs, s, n, tz)
    return prices.drop("step").join(spikes, [*s.keys, "generated_at", s.ts])


def _label(scored: DataFrame, hist: DataFrame, runs: DataFrame, s: Series) -> DataFrame:
    on = [*s.keys, "generated_at"]
    out = scored.join(_last_state(hist, runs, s), on, "left")
    label = regime("spike_proba", F.coalesce("last_direction", F.lit(0)), F.coalesce("last_price", F.lit(0.0)))
    return out.select(*on, s.ts, "spike_proba", label.alias("regime"))


def run_cutoffs(hist: DataFrame, first: str, last: str, s: Series = QUARTER, tz: str = cal.LOCAL_ZONE, min_rows: int = 96) -> DataFrame:
    """(keys, generated_at): 23:45 local of each day, for series with at least
    ``min_rows`` known prices by then."""
    day = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date")))
    # The first cutoff that sees a row: rows after 23:45 belong to the day after.
    sees = F.to_date(F.from_utc_timestamp(s.ts, tz) + F.expr("INTERVAL '899.999999' SECOND"))
    known = hist.where(F.col("imbl_price").isNotNull()).select(*s.keys, F.greatest(sees, F.lit(first).cast("date")).alias("_day"))
    new = known.groupBy(*s.keys, "_day").agg(F.count(F.lit(1)).alias("_n"))
    days = hist.select(*s.keys).distinct().withColumn("_day", day)
    upto = Window.partitionBy(*s.keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    seen = days.join(new, [*s.keys, "_day"], "left").withColumn("_seen", F.sum("_n").over(upto))
    local = F.col("_day").cast("timestamp") + F.expr("INTERVAL '23:45' HOUR TO MINUTE")
    cut = seen.withColumn("generated_at", F.to_utc_timestamp(local, tz))
    return cut.where(F.col("_seen") >= min_rows).select(*s.keys, "generated_at")


def hindcast(
    hist: DataFrame, feats: DataFrame, price_model: QuantileForest, spike_model: SpikeModel,
    first: str, last: str, s: Series = QUARTER, tz: str = cal.LOCAL_ZONE, n: int = MEMORY,
) -> DataFrame:
    """Forecasts as they would have been made at the end of each local day.

    ``hist`` and ``feats`` are read several times, so they should be written tables.
    Features are computed once for all days; each run reads only the row at its cutoff
    and earlier ones.  The result fits ``Store.save_run`` row for row.
    """
    runs = run_cutoffs(hist, first, last, s, tz)
    # The path is read by the second model and again beside its result.
    fc = materialize(forecast_recursive(hist, feats, price_model, runs, s, n, tz), "forecast")
    spikes = forecast_spike_path(fc, hist, feats, spike_model, runs, s, tz)
    return fc.drop("step").join(spikes, [*s.keys, "generated_at", s.ts], "left")


def folds(df: DataFrame, n: int = 3, days: int = 30, test_days: int = 0, s: Series = QUARTER) -> list[tuple[Column, Column]]:
    """(train, test) conditions of expanding-window folds ending before the test span."""
    lo, hi = df.agg(F.min(s.ts), F.max(s.ts)).first()
    whole = (hi - lo).days
    start = lo + pd.Timedelta(days=whole - n * days - test_days).to_pytimedelta()
    out = []
    for k in range(n):
        a = start + pd.Timedelta(days=k * days).to_pytimedelta()
        b = a + pd.Timedelta(days=days).to_pytimedelta()
        out.append((F.col(s.ts) < F.lit(a), (F.col(s.ts) >= F.lit(a)) & (F.col(s.ts) < F.lit(b))))
    return out


def walk_forward(
    feats: DataFrame, s: Series = QUARTER, n: int = 3, days: int = 30, test_days: int = 60,
    threshold: float = 0.45, rounds: int = 20, least_train: int = 1000, least_test: int = 100,
    known: set[str] | None = None,
) -> DataFrame:
    """Spike metrics per fold and their mean (fold 0)."""
    rows = materialize(feats.dropna(subset=["target_binary", *CORE_LAGS]))
    features = _known_features(rows, "spike", known)
    parts = []
    for k, (train, test) in enumerate(folds(rows, n, days, test_days, s), start=1):
        a, b = rows.where(train), rows.where(test)
        if a.count() < least_train or b.count() < least_test:
            continue
        model = fit_spike(a, features, s, rounds=rounds, threshold=threshold, class_weight=40.0)
        scored = model.transform(b)
        m = evaluate.threshold_table(scored, "spike_proba", "target_binary", {"at": threshold})
        prev = scored.agg(F.avg("target_binary").alias("spike_prevalence"))
        parts.append(attach(m, prev, []).withColumn("fold", F.lit(k)))
    if not parts:
        raise ValueError("no fold has enough rows")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    cols = ["recall", "precision", "f2", "spike_prevalence"]
    mean = out.agg(*[F.avg(c).alias(c) for c in cols]).withColumn("fold", F.lit(0))
    return out.select("fold", *cols).unionByName(mean.select("fold", *cols))


def eval_horizons(
    hist: DataFrame, horizons: Sequence[int] = (1, 4, 8), s: Series = QUARTER, test_days: int = 60,
    trees: int = 20, depth: int = 6,
) -> DataFrame:
    """Error of the price model for several horizons, one fit each.

    The features do not depend on the horizon, so one matrix holds the targets of all; it
    is written once and each fit reads its own target column.
    """
    feats = materialize(fi.imbalance_features(hist, horizons, s), "features")
    parts = []
    for h in horizons:
        own = feats.withColumnsRenamed({f"{t}_{h}": t for t in fi.TARGETS})
        model, test = fit_imbalance(own, s, test_days, trees=trees, depth=depth)
        scored = score_imbalance(model, test)
        parts.append(evaluate.eval_imbalance(scored).withColumn("horizon", F.lit(h)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
