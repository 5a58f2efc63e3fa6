"""The one-sweep master frame against sources densified, filled and joined one by one."""

import re

import pytest
from pyspark.sql import functions as F

from gridtide.operators.blocks import QUARTER
from gridtide.operators.grid import densify, upsample
from gridtide.plans.master import master_frame
from gridtide.session import materialize
from tests.helpers import at, same_rows, series, wave_frame
from tests.test_plans import plan

SHORT = QUARTER.cut(37)


@pytest.fixture(scope="module")
def frames(spark):
    base = wave_frame(spark, 300).select("zone", "ts", "imbl_price", "direction").where("imbl_price is not null")
    wide = wave_frame(spark, 400, seed=5)
    hours = F.minute("ts") == 0
    weather = wide.where(hours & (F.col("temperature") > 0)).select("zone", "ts", "temperature", "cloudcover")
    # Values missing inside rows, a series that ends early and one that is not there.
    weather = weather.withColumn("cloudcover", F.when(F.col("cloudcover") > 30, F.col("cloudcover")))
    weather = weather.where((F.col("zone") == "A") | (F.col("ts") < F.lit(at(200)).cast("timestamp")))
    prices = wide.where(hours & (F.col("zone") == "A")).select("zone", "ts", F.col("up_reg_price").alias("price_eur_mwh"))
    return tuple(materialize(f) for f in (base, weather, prices))


def one_by_one(base, weather, prices, s, limits):
    out = densify(base, s)
    for df, limit in ((weather, limits[0]), (prices.withColumnRenamed("price_eur_mwh", "spot_price"), limits[1])):
        cols = [c for c in df.columns if c not in ("zone", "ts")]
        out = out.join(upsample(df, s, cols, limit), ["zone", "ts"], "left")
    return out


@pytest.mark.parametrize("s", [SHORT, QUARTER])
@pytest.mark.parametrize("limits", [(4, 4), (13, 0), (2, None)])
def test_sweep_equals_joins(frames, s, limits):
    base, weather, prices = frames
    got = master_frame(base, {"weather": weather, "prices": prices}, s, limits=dict(zip(("weather", "prices"), limits)))
    want = one_by_one(base, weather, prices, s, limits)
    assert got.columns == want.columns and same_rows(got, want)


def test_live_values_stand_in(spark, frames):
    base, weather, _ = frames
    live = weather.select("zone", "ts", (F.col("temperature") + 100).alias("temperature"), F.lit(1.0).alias("gust"))
    some = weather.where(F.hour("ts") < 12)
    got = master_frame(base, {"weather": some}, live=live)
    a = master_frame(base, {"weather": some}).withColumnRenamed("temperature", "t")
    b = master_frame(base, {"live": live}).select("zone", "ts", F.col("temperature").alias("l"), "gust")
    want = a.join(b, ["zone", "ts"]).withColumn("temperature", F.coalesce("t", "l")).drop("t", "l")
    assert got.where("temperature > 90").count() > 0 and same_rows(got, want)


def test_rows_off_the_grid_and_repeated_ones(spark):
    base = series(spark, {"imbl_price": [1.0, None, 3.0, 4.0, 5.0]})
    source = spark.createDataFrame([("A", at(1), 7.0), ("A", at(1), 7.0), ("A", at(2, 16), 9.0), ("A", at(9), 8.0)], "zone string, ts timestamp, x double")
    got = master_frame(base, {"s": source}, limit=1).orderBy("ts").collect()
    assert [r.x for r in got] == [None, 7.0, 7.0, None, None] and [r.imbl_price for r in got] == [1.0, None, 3.0, 4.0, 5.0]
    sparse = base.where("imbl_price > 2")
    assert [r.x for r in master_frame(sparse, {"s": source}, limit=3, dense=False).orderBy("ts").collect()] == [7.0, 7.0, 7.0][: 3]
    assert master_frame(base.limit(0), {"s": source}).count() == 0


def test_all_sources_are_exchanged_once(spark, frames):
    base, weather, prices = frames
    sources = {f"s{i}": weather.select("zone", "ts", F.col("temperature").alias(f"t{i}")) for i in range(6)}
    text = plan(master_frame(base, sources | {"prices": prices}))
    assert len(re.findall("Exchange hashpartitioning", text)) <= 3 and text.count("Window [") == 1
