"""Connected components of a graph given as an edge table.

Every round each node takes the smallest label among itself and its neighbours and then
the label of its label.  Labels and edges stay distributed; each round is written to the
shared folder, which cuts the lineage.  Both joins read written tables, so that skewed
labels (one component with most nodes) are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the smallest node that
    can be reached.  No edges: an empty result.  Loops and repeated edges do no harm."""
    links = materialize(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    labels = materialize(
        links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
            "node", F.least("node", "m").alias("label")
        ),
        "labels",
    )
    while True:
        near = (
            links.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        hooked = materialize(
            labels.join(near, "node").select(
                "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
            ),
            "hooked",
        )
        target = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = materialize(
            hooked.join(target, "label").select("node", "old", F.col("next").alias("label")), "labels"
        )
        if jumped.where("old <> label").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")
