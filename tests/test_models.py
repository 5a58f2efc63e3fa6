"""Models against brute force, and forecasts against their own definitions."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridtide.features import imbalance as fi
from gridtide.models import linear, quantile, spike, splits
from gridtide.operators.blocks import QUARTER
from gridtide.plans import evaluate, forecast
from tests.helpers import at, series, values, wave_frame


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 10, 6000)
    y = 3 * x + rng.normal(0, 1, 6000) * (0.5 + x)
    rows = [(float(a), float(b) if i % 50 else None, float(c)) for i, (a, b, c) in enumerate(zip(x, rng.normal(0, 1, 6000), y))]
    return spark.createDataFrame(rows, "x double, z double, y double").repartition(4).cache()


def test_ridge_equals_closed_form(spark, noisy):
    model = linear.fit_ridge(noisy, ["x", "z"], ["y"], alpha=1.0)
    rows = np.array([[r.x, r.z or 0.0, r.y] for r in noisy.collect()])
    x, y = rows[:, :2] - rows[:, :2].mean(0), rows[:, 2] - rows[:, 2].mean()
    w = np.linalg.solve(x.T @ x + np.eye(2), x.T @ y)
    assert np.allclose(model.weights["y"], w)
    assert np.isclose(model.r2["y"], 1 - ((y - x @ w) ** 2).sum() / (y**2).sum())
    got = noisy.select(F.avg(F.col("y") - model.explained("y"))).first()[0]
    assert abs(got) < 1e-8


@pytest.fixture(scope="module")
def forest(noisy):
    return quantile.fit_quantiles(noisy, ["x", "z"], "y", noisy.limit(1500), trees=8, depth=4)


def test_forest_covers_and_never_crosses(noisy, forest):
    out = forest.transform(noisy)
    r = out.agg(
        F.avg(((F.col("y") >= F.col("p05")) & (F.col("y") <= F.col("p95"))).cast("double")),
        F.min(F.least(F.col("p50") - F.col("p05"), F.col("p95") - F.col("p50"))),
    ).first()
    assert 0.85 < r[0] < 0.97 and r[1] >= 0


def leaves_of(model, df):
    rows = model.forest.transform(quantile.assemble(df, model.features))
    return np.array([r[0] for r in rows.select(vector_to_array("_leaf")).collect()]).astype(int)


def pooled(y, own, leaf, alpha):
    """Meinshausen's quantile from all training rows, one by one."""
    weights = np.zeros(len(y))
    for t, k in enumerate(leaf):
        same = own[:, t] == k
        weights[same] += 1 / same.sum()
    order = np.argsort(y, kind="stable")
    total = np.cumsum(weights[order]) / len(leaf)
    return y[order][np.searchsorted(total, alpha - 1e-9)]


@pytest.mark.parametrize("trees", [1, 10])
def test_forest_pools_the_rows_of_shared_leaves(noisy, trees):
    small = noisy.limit(400).cache()
    model = quantile.fit_quantiles(small, ["x", "z"], "y", trees=trees, depth=4)
    y = np.array([r.y for r in small.collect()])
    own = leaves_of(model, small)
    got = model.transform(small.limit(60)).select("p05", "p50", "p95").collect()
    want = [[pooled(y, own, leaf, a) for a in (0.05, 0.5, 0.95)] for leaf in leaves_of(model, small.limit(60))]
    assert np.allclose(np.array(got), np.array(want))


def test_large_grids_are_cut_at_equal_depth(noisy):
    grid = quantile.target_grid(noisy, "y", 50)
    y = np.sort([r.y for r in noisy.collect()])
    assert 45 <= len(grid) <= 52 and grid[0] == y[0] and grid[-1] == y[-1]
    share = np.searchsorted(y, grid) / len(y)
    assert np.diff(share).max() < 0.03


def test_early_stop_takes_the_best_prefix(spark):
    """Trees 0-3 know the target's side, the later ones say the opposite."""
    rng = np.random.default_rng(3)
    side, trees, good = rng.integers(0, 2, 300), 12, 4
    y = np.where(side == 1, 10.0, 0.0) + rng.integers(0, 3, 300)
    leaves = np.stack([side if t < good else 1 - side for t in range(trees)], axis=1).astype(float)
    grid = np.unique(y)
    fits = [np.stack([(y[side == k][:, None] == grid).sum(axis=0) for k in (0, 1)]) for _ in range(trees)]
    table = quantile.LeafTable(grid, fits)
    rows = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(y, leaves)], "_y double, _leaf array<double>").repartition(3)
    alphas = [0.05, 0.5, 0.95]
    losses = quantile.prefix_losses(rows, table, alphas)
    plain = [quantile.pinball(y, table.quantiles(leaves[:, :k], alphas), alphas).mean() for k in range(1, trees + 1)]
    assert np.allclose(losses, plain)
    assert quantile.stop_early(losses) == int(np.argmin(plain)) + 1 <= good + 2
    assert quantile.prefix_losses(rows.limit(0), table, alphas) == []


def test_patience():
    assert quantile.stop_early([3, 2, 2, 2.5, 1], patience=2) == 2
    assert quantile.stop_early([3, 2, 2, 2.5, 1], patience=3) == 5
    assert quantile.stop_early([5.0]) == 1 and quantile.stop_early([]) == 0


def test_comoments_far_from_zero(spark):
    """Raw sums of squares of such a column keep no digit of its spread."""
    rng = np.random.default_rng(4)
    x, z = 1e8 + rng.normal(0, 1, 3000), rng.normal(0, 1, 3000)
    y = 2 * (x - 1e8) - z + rng.normal(0, 0.1, 3000)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, z, y)], "x double, z double, y double").repartition(7)
    n, mean, c = linear.comoments(df, ["x", "z", "y"])
    d = np.column_stack([x - 1e8, z, y])  # this difference is exact
    d = d - d.mean(axis=0)
    assert n == 3000 and np.allclose(c, d.T @ d, rtol=0, atol=1e-9 * n)
    model = linear.fit_ridge(df, ["x", "z"], ["y"])
    w = np.linalg.solve(d[:, :2].T @ d[:, :2] + np.eye(2), d[:, :2].T @ d[:, 2])
    assert np.allclose(model.weights["y"], w, rtol=1e-9)
    with pytest.raises(ValueError, match="no rows"):
        linear.fit_ridge(df.limit(0), ["x"], ["y"])


def test_interactions_are_rebuilt_from_what_is_there(spark):
    df = spark.createDataFrame([(4.0, 1, 9.0)], "windspeed_10m double, is_night int, wind_x_night double")
    model = linear.Ridge([], {"windspeed_10m": []}, {"windspeed_10m": 1.0})
    row = linear.neutralize(df, model).first()
    assert (row.windspeed_10m, row.wind_x_night, row.wind_squared) == (3.0, 3.0, 9.0)


def test_node_tables_reach_the_same_leaves(noisy, forest):
    rows = forest.forest.transform(quantile.assemble(noisy.limit(400), forest.features))
    rows = rows.select(vector_to_array("_features").alias("x"), vector_to_array("_leaf").alias("l")).collect()
    x = np.array([r.x for r in rows])
    for i, t in enumerate(quantile.node_tables(forest)):
        assert (quantile.leaf_of(x, t, 4) == np.array([int(r.l[i]) for r in rows])).all()


def test_forest_survives_saving(spark, noisy, forest, tmp_path):
    forest.save(str(tmp_path / "m"))
    again = quantile.QuantileForest.load(str(tmp_path / "m"))
    a = forest.transform(noisy.limit(50)).select("x", "p05", "p95").collect()
    assert sorted(a) == sorted(again.transform(noisy.limit(50)).select("x", "p05", "p95").collect())
    with pytest.raises(FileNotFoundError):
        forecast.SpotModel.load(str(tmp_path / "none"))


def test_splits_and_augmentation(spark):
    df = series(spark, {"y": [0.0] * 10 + [1.0] + [0.0] * 9})
    held = splits.tail_fraction(df, QUARTER, 0.1, 3)
    assert values(held, "valid") == [False] * 17 + [True] * 3
    more = splits.augment(df, QUARTER, F.col("y") > 0)
    assert more.count() == 25 and more.where("y > 0").count() == 2
    weight = splits.augmented_weight(df, QUARTER, F.col("y") > 0)
    assert values(weight, "weight") == [1.0] * 8 + [2.0] * 5 + [1.0] * 7
    rows = spike.training_rows(df.withColumnRenamed("y", "target_binary"), held=0.5)
    # The only spike lies in the held-out half: it gets its class weight and no copies.
    assert values(rows, "weight")[10] == 25.0 and sum(values(rows, "weight")) == 44.0


@pytest.fixture(scope="module")
def history(spark):
    """A persistent series with a daily wave."""
    rng = np.random.default_rng(9)
    n, level, price = 1500, 0.0, []
    for k in range(n):
        level = 0.9 * level + rng.normal(0, 25)
        price.append(float(40 + 60 * np.sin(2 * np.pi * k / 96) + level))
    cols = {"imbl_price": price, "direction": [int(np.sign(p)) for p in price]}
    return series(spark, cols).cache()


@pytest.fixture(scope="module")
def feats(history):
    return fi.imbalance_features(history).cache()


@pytest.fixture(scope="module")
def price_model(feats):
    return forecast.fit_imbalance(feats, test_days=3, trees=6, depth=4)


def test_price_model_beats_persistence_far_ahead(spark, history):
    feats4 = fi.imbalance_features(history, horizon=8)
    model, test = forecast.fit_imbalance(feats4, test_days=3, trees=10, depth=5)
    m = evaluate.eval_imbalance(forecast.score_imbalance(model, test)).first()
    assert m.skill > 0 and 75 < m.coverage <= 100


def test_recursion_starts_like_one_step_and_is_whole(history, feats, price_model):
    model, _ = price_model
    runs = history.groupBy("zone").agg(F.max("ts").alias("generated_at"))
    runs = runs.unionByName(runs.select("zone", F.lit(at(900)).cast("timestamp").alias("generated_at")))
    fc = forecast.forecast_recursive(history, feats, model, runs).cache()
    assert fc.count() == 2 * 96 and fc.select("generated_at", "ts").distinct().count() == 192
    assert fc.where("p50 < p05 or p95 < p50").isEmpty()
    # The first step sees the true history, so it equals scoring the next feature row.
    first = fc.where((F.col("step") == 1) & (F.col("generated_at") == F.lit(at(900)).cast("timestamp"))).first()
    assert first.ts == at(901).replace(tzinfo=None)
    row = model.transform(feats.where(F.col("ts") == F.lit(at(901)).cast("timestamp"))).first()
    moved = set(forecast.PATH_FEATURES) | set(fi.CALENDAR)
    if all(c in moved for c, v in model.importances() if v > 0):
        assert np.isclose(first.p50, row.p50)
    assert abs(first.p50 - row.p50) < 40


def test_hindcast_uses_only_the_past(spark, history, feats, price_model):
    model, _ = price_model
    spikes, _ = forecast.fit_spike_model(
        feats.withColumn("target_binary", (F.col("target_price") > 100).cast("int")), test_days=3, rounds=3, least=50
    )
    go = lambda h: forecast.hindcast(h, fi.imbalance_features(h).cache(), model, spikes, "2025-01-05", "2025-01-07")
    a = go(history)
    cut = F.lit("2025-01-06 22:45:00").cast("timestamp")
    later = history.withColumn("imbl_price", F.when(F.col("ts") > cut, -999.0).otherwise(F.col("imbl_price")))
    early = lambda d: {(r.ts, r.p50, r.spike_proba, r.regime) for r in d.where(F.col("generated_at") <= cut).collect()}
    rows = a.collect()
    assert len(rows) == 3 * 96 and all(r.spike_proba is not None and r.regime for r in rows)
    assert early(a) == early(go(later))


def test_path_spikes_follow_the_path(history, feats, price_model):
    model, _ = price_model
    runs = history.groupBy("zone").agg(F.max("ts").alias("generated_at"))
    spikes, _ = forecast.fit_spike_model(
        feats.withColumn("target_binary", (F.col("target_price") > 100).cast("int")), test_days=3, rounds=3, least=50
    )
    still = forecast.forecast_spike(history, feats, spikes, runs)
    assert still.count() == 96 and still.where("spike_proba < 0 or spike_proba > 1").isEmpty()
    fc = forecast.forecast_recursive(history, feats, model, runs).cache()
    path = forecast.forecast_spike_path(fc, history, feats, spikes, runs)
    assert path.count() == 96


def test_runs_after_long_holes_still_forecast(spark, history, feats, price_model):
    # Five days without a price: runs in and after the hole start from the last complete row.
    model, _ = price_model
    hole = (F.col("ts") > F.lit(at(700)).cast("timestamp")) & (F.col("ts") < F.lit(at(700 + 5 * 96)).cast("timestamp"))
    holed = history.withColumns({c: F.when(~hole, F.col(c)) for c in ("imbl_price", "direction")})
    runs = spark.createDataFrame([("A", at(k)) for k in (650, 701, 900, 1170)], "zone string, generated_at timestamp")
    rows = fi.imbalance_features(holed).cache()
    fc = forecast.forecast_recursive(holed, rows, model, runs).cache()
    counts = {r.generated_at: r["count"] for r in fc.groupBy("generated_at").count().collect()}
    assert len(counts) == 4 and set(counts.values()) == {96}
    spikes, _ = forecast.fit_spike_model(
        feats.withColumn("target_binary", (F.col("target_price") > 100).cast("int")), test_days=3, rounds=3, least=50
    )
    path = forecast.forecast_spike_path(fc, holed, rows, spikes, runs)
    still = forecast.forecast_spike(holed, rows, spikes, runs)
    assert path.count() == still.count() == 4 * 96
    known = {r.generated_at: r.last_price for r in forecast._last_state(holed, runs, QUARTER).collect()}
    assert None not in known.values()


def test_cutoffs_count_known_rows(spark):
    # One early price and a long hole: the span is long enough, the rows are not.
    price = [1.0] + [None] * 400 + [2.0] * 300
    df = series(spark, {"imbl_price": price, "direction": [1] * len(price)})
    got = [str(r.generated_at) for r in forecast.run_cutoffs(df, "2025-01-02", "2025-01-08").orderBy("generated_at").collect()]
    want = [
        f"2025-01-0{d} 22:45:00" for d in range(2, 9)
        if sum(p is not None for p in price[: (d - 1) * 96 + 92]) >= 96
    ]
    assert got == want and len(want) < 7
