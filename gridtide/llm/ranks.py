"""Ranks in a global order without one task for a whole group.

Rows are range-partitioned and sorted; a row's place in its partition comes with the scan,
and the places where its group goes on in earlier partitions are added from one count per
(group, partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.session import materialize


def ranked(df: DataFrame, order: list[Column], group: str | None = None, name: str = "rank") -> DataFrame:
    """``df`` as a written table with ``name``, the rank (from 0) by ``order``, counted
    within ``group`` if one is given; the order has to begin with the group then."""
    # A partition's rows are numbered upwards; the bits from the 33rd on are the partition.
    at = F.monotonically_increasing_id()
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "sorted")
    by = [group] if group else []
    part = F.shiftright("_at", 33).alias("_part")
    runs = rows.groupBy(*by, part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        runs.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_first", "_n"), "starts"
    )
    same = F.col("l._part") == F.col("r._part")
    if group:
        same = same & F.col(f"l.{group}").eqNullSafe(F.col(f"r.{group}"))
    joined = rows.withColumn("_part", F.shiftright("_at", 33)).alias("l").join(starts.alias("r"), same)
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("l._at") + F.col("r._start")).alias(name))
