"""Ridge regressions from one pass of mergeable co-moments.

All targets share the basis, so the counts, means and centred products of all columns hold
everything needed.  Each batch gives its own, centred on its own means; two of them merge
without ever forming raw sums of squares (parallel covariance), so a column far from zero
keeps its digits.  Partitions merge their batches, tasks merge groups of partitions, and
one row reaches the driver; the systems solved there have the size of the basis whatever
the row count.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.features.spot import HARMONICS, interaction_columns, wind_column

# Columns of the linear part and the features freed from it.
TIME_BASIS = ["price_ewa", "price_roll_720h_mean", "price_roll_168h_mean", *HARMONICS]
NEUTRAL_FEATURES = [
    "windspeed_100m", "windspeed_10m", "wind_surprise", "wind_7d_mean", "temperature",
    "heating_degree", "load_lag24", "load_residual", "wind_gen_lag24", "wind_load_ratio",
    "cloudcover", "smhi_wind_speed_ms", "smhi_wind_surprise", "smhi_cloud_fraction",
    "smhi_temperature_c", "fcst_wind_100m", "fcst_wind_10m", "fcst_cloud_cover",
    "fcst_temperature", "fcst_wind_surprise", "fcst_cloud_surprise", "imbl_price_lag24",
    "imbl_roll_24h_mean", "imbl_roll_24h_std",
]


FAN_IN = 64  # groups of partitions whose results are merged, one task each

Moments = tuple[int, np.ndarray, np.ndarray]


def merged(a: Moments, b: Moments) -> Moments:
    """Count, means and centred products of two sets of rows together."""
    (n, m, c), (k, p, d) = a, b
    if not n or not k:
        return b if not n else a
    apart = p - m
    return n + k, m + apart * (k / (n + k)), c + d + np.outer(apart, apart) * (n * k / (n + k))


def comoments(df: DataFrame, cols: Sequence[str]) -> Moments:
    """Rows, means and the matrix of centred products of columns (missing values as 0)."""
    names, w = list(cols), len(cols)
    schema = "part bigint, n bigint, mean array<double>, products array<double>"

    def row(part: int, x: Moments) -> pd.DataFrame:
        return pd.DataFrame({"part": [part], "n": [x[0]], "mean": [x[1].tolist()], "products": [x[2].ravel().tolist()]})

    def none() -> Moments:
        return 0, np.zeros(w), np.zeros((w, w))

    def of_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = none()
        for b in batches:
            if len(b):
                x = b.to_numpy(dtype=float)
                mean = x.mean(axis=0)
                total = merged(total, (len(x), mean, (x - mean).T @ (x - mean)))
        if total[0]:
            yield row(TaskContext.get().partitionId(), total)

    def of_parts(rows: pd.DataFrame) -> pd.DataFrame:
        total = none()
        for r in rows.sort_values("part").itertuples():
            total = merged(total, (r.n, np.asarray(r.mean), np.asarray(r.products).reshape(w, w)))
        return row(int(rows["part"].iloc[0]), total)

    src = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    parts = src.mapInPandas(of_rows, schema)
    groups = parts.withColumn("part", F.col("part") % FAN_IN).groupBy("part").applyInPandas(of_parts, schema)
    total = none()
    for r in groups.orderBy("part").collect():  # at most FAN_IN
        total = merged(total, (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(w, w)))
    return total


@dataclass
class Ridge:
    """Coefficients per target over a shared basis."""

    basis: list[str]
    weights: dict[str, list[float]]
    intercepts: dict[str, float]
    r2: dict[str, float] = field(default_factory=dict)

    def explained(self, target: str) -> Column:
        """The linear prediction, as one SQL text (a sum over the basis)."""
        terms = [
            f"coalesce(CAST(`{c}` AS DOUBLE), 0D) * ({w!r}D)"
            for c, w in zip(self.basis, self.weights[target])
        ]
        return F.expr(" + ".join([f"({self.intercepts[target]!r}D)", *terms]))


def fit_ridge(df: DataFrame, basis: Sequence[str], targets: Sequence[str], alpha: float = 1.0) -> Ridge:
    """Ridge with a free intercept: both sides are centred before the penalty."""
    basis, targets = list(basis), list(targets)
    n, mean, cov = comoments(df, [*basis, *targets])
    if n == 0:
        raise ValueError("no rows to fit on")
    k = len(basis)
    solved = np.linalg.solve(cov[:k, :k] + alpha * np.eye(k), cov[:k, k:])
    weights, intercepts, r2 = {}, {}, {}
    for j, t in enumerate(targets):
        w = solved[:, j]
        weights[t] = [float(x) for x in w]
        intercepts[t] = float(mean[k + j] - mean[:k] @ w)
        total = cov[k + j, k + j]
        left = total - 2 * w @ cov[:k, k + j] + w @ cov[:k, :k] @ w
        r2[t] = float(1 - left / total) if total > 0 else 0.0
    return Ridge(basis, weights, intercepts, r2)


def fit_neutralizer(
    train: DataFrame, features: Sequence[str], basis: Sequence[str] = tuple(TIME_BASIS)
) -> Ridge:
    """What each listed feature shares with the time basis; fit on training rows only."""
    targets = [c for c in NEUTRAL_FEATURES if c in features and c in train.columns]
    return fit_ridge(train, [c for c in basis if c in train.columns], targets)


def neutralize(df: DataFrame, model: Ridge) -> DataFrame:
    """Subtract the shared part and rebuild the interactions of the changed features."""
    out = df.withColumns(
        {t: F.col(t) - model.explained(t) for t in model.weights if t in df.columns}
    )
    have, w = set(out.columns), wind_column(out.columns)
    flags = {"night": "is_night", "peak": "is_peak", "weekend": "is_weekend", "winter": "season", "summer": "season"}
    inputs = {"wind_squared": {w}} | {f"wind_x_{n}": {w, c} for n, c in flags.items()}
    inputs |= {f"temp_x_{n}": {"temperature", c} for n, c in flags.items()}
    # Only what the changed columns enter, and only where all inputs are there.
    again = [n for n, need in inputs.items() if w is not None and need <= have]
    if again:
        every = interaction_columns(w)
        out = out.withColumns({n: every[n] for n in again if n in every})
    if {"wind_surprise", "is_night", "price_ewa"} <= set(out.columns):
        out = out.withColumns(
            {
                "wind_surprise_x_night": F.col("wind_surprise") * F.col("is_night"),
                "wind_vs_ewa": F.col("wind_surprise") * F.col("price_ewa"),
            }
        )
    return out


def fit_baseline(train: DataFrame, target: str, basis: Sequence[str] = tuple(TIME_BASIS)) -> Ridge:
    return fit_ridge(train, [c for c in basis if c in train.columns], [target])


def with_baseline(df: DataFrame, model: Ridge, target: str) -> DataFrame:
    """Add the linear prediction and, where the target is known, what it leaves."""
    out = df.withColumn("baseline", model.explained(target))
    if target in df.columns:
        out = out.withColumn("residual", F.col(target) - F.col("baseline"))
    return out


def to_config(model: Ridge) -> Mapping:
    return {"basis": model.basis, "weights": model.weights, "intercepts": model.intercepts, "r2": model.r2}


def from_config(config: Mapping) -> Ridge:
    return Ridge(**config)
