"""Physical plans: exchanges, pushed filters, no row-wise Python."""

import re

from pyspark.sql import functions as F

from gridtide.features.imbalance import imbalance_features
from gridtide.operators import windows
from gridtide.operators.blocks import QUARTER
from gridtide.plans import adapters as A
from gridtide.session import materialize
from tests.helpers import wave_frame

SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def exchanges(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def test_bounded_windows_share_one_exchange(spark):
    df = materialize(wave_frame(spark, 50))
    out = windows.rolling(df, QUARTER, "imbl_price", 16, ["mean", "std", "max"])
    assert exchanges(out) == 1


def test_feature_matrix_moves_wide_rows_once(spark):
    df = materialize(wave_frame(spark, 50))
    text = plan(imbalance_features(df))
    # One exchange of the wide rows, one of the narrow run-length pass, and small ones
    # of its per-block summaries.
    wide = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)]
    assert sum("_blk" in x for x in wide) <= 4 and len(wide) <= 6
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert "Exchange SinglePartition" not in text and "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_what_is_used(spark):
    e = A.prices(spark, SF)
    text = plan(e)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"ts", "user_id", "value"}
    # Aggregation is combined before its exchange.
    assert text.count("HashAggregate") == 2


def test_time_filters_reach_the_scan(spark):
    e = A.read(spark, SF, "events")
    text = plan(e.where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).select("value"))
    assert "GreaterThanOrEqual(ts" in text
