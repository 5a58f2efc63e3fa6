"""Weighted spike classifier on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.functions.scalars import is_spike
from gridtide.models.quantile import assemble
from gridtide.models.splits import augmented_weight, clean, tail_fraction
from gridtide.operators.blocks import QUARTER, Series
from gridtide.session import materialize

CLASS_WEIGHT = 25.0


@dataclass
class SpikeModel:
    features: list[str]
    model: GBTClassificationModel
    threshold: float = 0.45

    def transform(self, df: DataFrame, out: str = "spike_proba") -> DataFrame:
        kept = df.columns
        scored = self.model.transform(assemble(clean(df, self.features), self.features))
        proba = scored.withColumn(out, vector_to_array("_proba")[1])
        keep = [c for c in kept if c not in self.features]
        # Features are scored after cleaning; the caller's columns stay as they were.
        return proba.select(*keep, *[c for c in self.features if c in kept], out)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        row = [(self.features, float(self.threshold))]
        spark = SparkSession.active()
        spark.createDataFrame(row, "features array<string>, threshold double").write.mode(
            "overwrite"
        ).json(f"{path}/config")

    @classmethod
    def load(cls, path: str) -> "SpikeModel":
        spark = SparkSession.active()
        c = spark.read.schema("features array<string>, threshold double").json(f"{path}/config").first()
        return cls(list(c["features"]), GBTClassificationModel.load(f"{path}/model"), c["threshold"])

    def importances(self) -> list[tuple[str, float]]:
        return list(zip(self.features, self.model.featureImportances.toArray().tolist()))


def training_rows(
    train: DataFrame, s: Series = QUARTER, label: str = "target_binary", held: float = 0.1,
    least: int = 0, k: int = 2, class_weight: float = CLASS_WEIGHT,
) -> DataFrame:
    """Flag the held-out tail, then weight the rest: spikes by class weight, and double
    near a spike.  The tail is taken first, so it keeps its true mix."""
    tagged = tail_fraction(train, s, held, least)
    spike = (F.col(label) > 0) & ~F.col("valid")
    near = augmented_weight(tagged, s, spike, k)
    cls = F.when(F.col(label) > 0, F.lit(class_weight)).otherwise(F.lit(1.0))
    return near.withColumn("weight", F.when(F.col("valid"), cls).otherwise(cls * F.col("weight")))


def fit_spike(
    train: DataFrame, features: Sequence[str], s: Series = QUARTER, label: str = "target_binary",
    rounds: int = 20, depth: int = 4, least: int = 0, seed: int = 7, threshold: float = 0.45,
    class_weight: float = CLASS_WEIGHT,
) -> SpikeModel:
    """Boosted trees that stop when the held-out tail no longer improves."""
    rows = training_rows(train.where(F.col(label).isNotNull()), s, label, least=least, class_weight=class_weight)
    vec = assemble(clean(rows, features), features).select(
        "_features", F.col(label).cast("double").alias("_y"), "weight", "valid"
    )
    vec = materialize(vec)
    grower = GBTClassifier(
        featuresCol="_features", labelCol="_y", weightCol="weight", validationIndicatorCol="valid",
        predictionCol="_pred", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8,
        seed=seed,
    )
    grower.setProbabilityCol("_proba").setRawPredictionCol("_raw")
    return SpikeModel(list(features), grower.fit(vec), threshold)


def spike_label(price: str, high: float = 200.0, low: float | None = -100.0):
    return is_spike(price, high, low).cast("int")


# How feature names are grouped in importance tables.
GROUPS = [
    ("imbalance", ("imbl_", "dir_"), ()),
    ("weather", (), ("wind", "temp", "cloud", "heat", "demand", "solar_rad")),
    ("weather_forecast", ("smhi_", "mesan_"), ()),
    ("nuclear", ("nuclear_",), ()),
    ("generation_forecast", ("solar_gen",), ("forecast",)),
    ("flows", ("flow_",), ("net_pos",)),
    ("spreads", (), ("reg_spread", "spot")),
]


def group_of(name: str) -> str:
    for group, starts, holds in GROUPS:
        if name.startswith(starts) or any(h in name for h in holds):
            return group
    return "other"


def importance(spark: SparkSession, pairs: Sequence[tuple[str, float]]) -> DataFrame:
    """(feature, importance, group), one row per feature of a model."""
    rows = [(n, float(v), group_of(n)) for n, v in pairs]
    return spark.createDataFrame(rows, "feature string, importance double, source string")


def top_features(imp: DataFrame, k: int) -> DataFrame:
    return imp.orderBy(F.col("importance").desc(), "feature").limit(k)
