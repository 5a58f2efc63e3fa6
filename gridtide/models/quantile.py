"""Quantile regression forest on Spark ML.

A random forest is grown as usual.  The quantile of a row is that of all training rows
that share a leaf with it, each weighing one over the size of the shared leaf, averaged
over the trees (Meinshausen 2006): one pooled distribution, not a mean of leaf quantiles.

What is kept of the training rows is, per (tree, leaf), how many have their target in each
cell of one ascending grid of target values.  These counts add up over partitions, and the
grid has at most ``GRID`` values: all distinct targets where there are no more, else cuts
of equal depth.  So the table is trees x leaves x grid numbers whatever the number of rows
(10 MB for 20 trees of 64 leaves), which is what allows its broadcast, and the pooled
quantile is exact on the grid.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gridtide.operators.quantiles import bucket_of
from gridtide.session import scratch_path

ALPHAS = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
# Trees split on numbers only: a missing value is moved below every real one, so a
# split can send it to its own side.
MISSING = -1e6
GRID = 1024
PATIENCE = 50  # trees without gain after which no larger forest is looked at
ROUNDING = 1e-9  # of a sum of leaf shares


def present(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(MISSING)).otherwise(x)


def assemble(df: DataFrame, features: Sequence[str], out: str = "_features") -> DataFrame:
    filled = [f"_x_{i}" for i in range(len(features))]
    df = df.withColumns({f: present(c) for f, c in zip(filled, features)})
    return VectorAssembler(inputCols=filled, outputCol=out).transform(df).drop(*filled)


@dataclass
class LeafTable:
    """Training rows per (tree, leaf) and cell of an ascending grid of targets."""

    grid: np.ndarray
    counts: list[np.ndarray]  # per tree: (leaves, grid)
    shares: np.ndarray = field(init=False)  # all leaves: share of rows at or below a grid value
    first: np.ndarray = field(init=False)  # row of each tree's first leaf in ``shares``

    def __post_init__(self) -> None:
        every = np.concatenate(self.counts).astype(float)
        size = every.sum(axis=1, keepdims=True)
        # A leaf that no training row falls into says what all rows say.
        whole = self.counts[0].sum(axis=0) if self.counts else np.zeros(len(self.grid))
        every = np.where(size > 0, every, whole)
        self.shares = np.cumsum(every, axis=1) / np.maximum(every.sum(axis=1, keepdims=True), 1)
        self.first = np.cumsum([0, *[len(c) for c in self.counts[:-1]]])

    def quantiles(self, leaves: np.ndarray, alphas: Sequence[float], trees: int | None = None) -> np.ndarray:
        """(rows, alphas) for rows given by their leaf in each tree; the smallest grid value
        at which the pooled share reaches alpha, found by bisection."""
        trees = trees or leaves.shape[1]
        at = self.first[:trees] + leaves[:, :trees].astype(int)
        out = np.empty((len(leaves), len(alphas)))
        for j, a in enumerate(alphas):
            low, high = np.zeros(len(at), dtype=int), np.full(len(at), len(self.grid) - 1)
            for _ in range(len(self.grid).bit_length()):
                mid = (low + high) // 2
                enough = self.shares[at, mid[:, None]].sum(axis=1) >= a * trees - ROUNDING
                low, high = np.where(enough, low, mid + 1), np.where(enough, mid, high)
                low = np.minimum(low, high)
            out[:, j] = self.grid[high]
        return out


@dataclass
class QuantileForest:
    features: list[str]
    forest: RandomForestRegressionModel
    table: LeafTable
    trees: int
    alphas: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.table)
        names, alphas, trees = list(self.alphas), list(self.alphas.values()), self.trees

        @pandas_udf(", ".join(f"{n} double" for n in names))
        def pooled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for b in batches:
                leaves = np.stack(b.to_numpy()) if len(b) else np.zeros((0, trees))
                yield pd.DataFrame(shared.value.quantiles(leaves, alphas, trees), columns=names)

        scored = self.forest.transform(assemble(df, self.features))
        scored = scored.withColumn("_q", pooled(vector_to_array("_leaf"))).drop("_features", "_leaf", "_mean")
        return scored.withColumns({n: F.col("_q")[n] for n in names}).drop("_q")

    def save(self, path: str) -> None:
        self.forest.write().overwrite().save(f"{path}/forest")
        spark = SparkSession.active()
        config = {"features": self.features, "trees": self.trees, "alphas": self.alphas, "grid": self.table.grid.tolist()}
        spark.createDataFrame([(json.dumps(config),)], "config string").write.mode("overwrite").json(f"{path}/config")
        rows = [(t, i, leaf.tolist()) for t, tree in enumerate(self.table.counts) for i, leaf in enumerate(tree)]
        spark.createDataFrame(rows, "tree int, leaf int, counts array<bigint>").write.mode("overwrite").parquet(f"{path}/leaves")

    @classmethod
    def load(cls, path: str) -> "QuantileForest":
        spark = SparkSession.active()
        config = json.loads(spark.read.schema("config string").json(f"{path}/config").first()["config"])
        by_tree: dict[int, list] = {}
        for r in spark.read.parquet(f"{path}/leaves").orderBy("tree", "leaf").collect():
            by_tree.setdefault(r["tree"], []).append(r["counts"])
        table = LeafTable(np.array(config.pop("grid")), [np.array(by_tree[t]) for t in sorted(by_tree)])
        return cls(forest=RandomForestRegressionModel.load(f"{path}/forest"), table=table, **config)

    def importances(self) -> list[tuple[str, float]]:
        return list(zip(self.features, self.forest.featureImportances.toArray().tolist()))


def fit_quantiles(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    valid: DataFrame | None = None,
    alphas: dict[str, float] | None = None,
    trees: int = 20,
    depth: int = 6,
    seed: int = 7,
    grid: int = GRID,
    patience: int = PATIENCE,
) -> QuantileForest:
    """Grow a forest and fill its leaves.  With a validation frame the first trees are
    used up to the number with the least pinball loss there, not looking further once
    ``patience`` more trees have brought no gain."""
    alphas = alphas or ALPHAS
    rows = assemble(train.where(F.col(label).isNotNull()), features).select("_features", F.col(label).cast("double").alias("_y"))
    grower = RandomForestRegressor(
        featuresCol="_features", labelCol="_y", predictionCol="_mean", leafCol="_leaf",
        numTrees=trees, maxDepth=depth, minInstancesPerNode=20, featureSubsetStrategy="onethird",
        subsamplingRate=0.8, seed=seed,
    )
    forest = grower.fit(rows)
    leaves = forest.transform(rows).select("_y", vector_to_array("_leaf").alias("_leaf"))
    table = leaf_table(leaves, [(t.numNodes + 1) // 2 for t in forest.trees], target_grid(rows, "_y", grid))
    model = QuantileForest(list(features), forest, table, trees, alphas)
    if valid is not None:
        rows = forest.transform(assemble(valid.where(F.col(label).isNotNull()), features))
        rows = rows.select(F.col(label).cast("double").alias("_y"), vector_to_array("_leaf").alias("_leaf"))
        model.trees = stop_early(prefix_losses(rows, table, list(alphas.values())), patience) or trees
    return model


def target_grid(rows: DataFrame, y: str, size: int = GRID) -> np.ndarray:
    """All distinct targets if there are at most ``size``, else cuts of equal depth from a
    bounded sketch, with both ends."""
    few = rows.select(y).distinct().limit(size + 1).collect()
    if len(few) <= size:
        return np.sort(np.array([r[0] for r in few] or [0.0], dtype=float))
    cuts = ", ".join(f"{k / (size - 1)!r}D" for k in range(size))
    found = rows.agg(F.expr(f"approx_percentile({y}, array({cuts}), {20 * size})").alias("g"), F.min(y).alias("a"), F.max(y).alias("b")).first()
    return np.unique([found["a"], *found["g"], found["b"]])


def leaf_table(rows: DataFrame, sizes: Sequence[int], grid: np.ndarray) -> LeafTable:
    """Counts of ``rows`` (_y, _leaf: array by tree) per (tree, leaf, grid cell), combined
    before the shuffle; trees x leaves rows of at most grid numbers reach the driver."""
    bounds = F.expr("array(" + ",".join(f"{float(v)!r}D" for v in grid) + ")")
    cell = bucket_of(F.col("_y"), bounds, len(grid), strict=True)
    each = rows.select(cell.alias("c"), F.posexplode("_leaf").alias("t", "l"))
    counted = each.groupBy("t", F.col("l").cast("int").alias("l"), "c").agg(F.count(F.lit(1)).alias("n"))
    counts = [np.zeros((n, len(grid)), dtype=np.int64) for n in sizes]
    for r in counted.groupBy("t", "l").agg(F.collect_list("c").alias("c"), F.collect_list("n").alias("n")).collect():
        counts[r["t"]][r["l"]][np.array(r["c"])] = r["n"]
    return LeafTable(grid, counts)


def pinball(y: np.ndarray, q: np.ndarray, alphas: Sequence[float]) -> np.ndarray:
    """Loss per row, summed over the quantiles."""
    d = y[:, None] - q
    return np.where(d >= 0, d * np.array(alphas), d * (np.array(alphas) - 1)).sum(axis=1)


def prefix_losses(rows: DataFrame, table: LeafTable, alphas: Sequence[float]) -> list[float]:
    """Mean loss on ``rows`` (_y, _leaf) of the first 1, 2, ... trees, in one pass: each
    batch gives its sums for all sizes.  Empty for no rows."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for b in batches:
            if len(b):
                y, leaves = b["_y"].to_numpy(float), np.stack(b["_leaf"].to_numpy())
                losses = [pinball(y, shared.value.quantiles(leaves, alphas, k), alphas).sum() for k in range(1, leaves.shape[1] + 1)]
                total, n = np.array(losses) + (0 if total is None else total), n + len(b)
        if n:
            yield pd.DataFrame({"k": range(1, len(total) + 1), "loss": total, "n": n})

    found = rows.mapInPandas(sums, "k int, loss double, n bigint").groupBy("k").agg((F.sum("loss") / F.sum("n")).alias("loss"))
    return [r["loss"] for r in found.orderBy("k").collect()]


def stop_early(losses: Sequence[float], patience: int = PATIENCE) -> int:
    """Number of rounds (from 1) with the least loss before ``patience`` rounds in a row
    brought no gain; 0 without rounds."""
    best = 0
    for k, loss in enumerate(losses, 1):
        if not best or loss < losses[best - 1]:
            best = k
        elif k - best >= patience:
            break
    return best


# --- node tables for stepwise scoring inside tasks ------------------------------


def node_tables(model: QuantileForest) -> list[dict[str, np.ndarray]]:
    """Trees as arrays (feature, threshold, left, right, leaf) from the node table of the
    saved forest; leaves are numbered from left to right as in the leaf column."""
    spark = SparkSession.active()
    path = scratch_path(spark, "forest")
    model.forest.write().save(path)
    node = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").where(F.col("treeID") < model.trees).select(
        "treeID", node["id"].alias("id"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"), F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
    )
    by_tree: dict[int, list] = {}
    for r in rows.collect():  # the nodes of the trees: a bound set by their depth
        by_tree.setdefault(r["treeID"], []).append(r)
    tables = []
    for t in sorted(by_tree):
        nodes = sorted(by_tree[t], key=lambda r: r["id"])  # a node's subtree follows it, the left side first
        inner = np.array([r["left"] >= 0 for r in nodes])
        own = np.arange(len(nodes))
        pick = lambda c, other: np.array([r[c] if i else o for r, i, o in zip(nodes, inner, other)])
        tables.append(
            {
                "feature": pick("feature", -np.ones(len(nodes), int)), "threshold": pick("threshold", np.zeros(len(nodes))).astype(float),
                "left": pick("left", own), "right": pick("right", own), "leaf": np.where(inner, -1, np.cumsum(~inner) - 1),
            }
        )
    return tables


def leaf_of(x: np.ndarray, tree: dict[str, np.ndarray], depth: int) -> np.ndarray:
    """Leaf number of each row of a matrix, all rows going down together."""
    node = np.zeros(len(x), dtype=int)
    rows = np.arange(len(x))
    for _ in range(depth):
        f = tree["feature"][node]
        go_left = x[rows, np.maximum(f, 0)] <= tree["threshold"][node]
        node = np.where(f < 0, node, np.where(go_left, tree["left"][node], tree["right"][node]))
    return tree["leaf"][node]
