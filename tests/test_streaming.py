"""Streams run to their end give the batch results."""

import json
from datetime import timedelta

from pyspark.sql import functions as F

from gridtide.operators import windows
from gridtide.operators.blocks import QUARTER
from gridtide.plans import adapters as A
from gridtide.operators.joins import asof_row
from gridtide.sources import feeds
from gridtide.sources.tables import Store
from gridtide.streaming import jobs
from tests.helpers import at, same_rows, values, wave_frame


def _land(spark, df, folder):
    df.write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def test_ingest_is_idempotent(spark, tmp_path):
    land, store = tmp_path / "land", Store(spark, str(tmp_path / "t"))
    land.mkdir()
    rec = lambda k, p: {"timestampUTC": f"2025-01-01T0{k}:00:00Z", "imblSalesPrice": p}
    (land / "a.json").write_text(json.dumps([rec(0, 1), rec(1, 2)]))
    go = lambda ckpt: jobs.stream_ingest(
        jobs.stream_payloads(spark, str(land), "SE3"), store, "imbalance_prices", feeds.parse_imbalance, str(tmp_path / ckpt)
    ).awaitTermination()
    go("c1")
    (land / "b.json").write_text(json.dumps([rec(1, 9), rec(2, 3)]))
    go("c1")
    go("c2")  # a lost checkpoint replays everything
    assert values(store.scan("imbalance_prices"), "imbl_price") == [1.0, 2.0, 3.0]


def test_dedup_within_the_lag(spark, tmp_path):
    df = wave_frame(spark, 20, zones=("A",)).select("zone", "ts", "imbl_price")
    src = _land(spark, df.unionByName(df), str(tmp_path / "in"))
    out = str(tmp_path / "out")
    jobs.run_to_table(jobs.stream_dedup(src), out, str(tmp_path / "c")).awaitTermination()
    assert same_rows(spark.read.parquet(out), df)


def test_stress_rows_settle_in_order_and_late_ones_are_counted(spark, tmp_path):
    df = wave_frame(spark, 300).select("zone", "ts", "imbl_price")
    at_hand = F.col("ts") + F.make_dt_interval(mins=F.pmod(F.xxhash64("zone", "ts"), F.lit(720)).cast("int"))
    cut = F.lit("2025-01-02 12:00:00").cast("timestamp")
    beat = spark.createDataFrame([(None, at(600), None)], df.schema)
    late = df.where(F.col("zone") == "A").orderBy("ts").limit(2)
    folder, out, side = (str(tmp_path / n) for n in ("in", "out", "late"))

    def take(part):
        src = _land(spark, part, folder)
        jobs.split_late(jobs.stream_stress(src, limit=100.0), out, side, str(tmp_path / "c")).awaitTermination()
        return spark.read.parquet(out).drop("_batch")

    first = take(df.where(at_hand < cut))
    # Only what the watermark has passed is settled.
    newest = df.where(at_hand < cut).agg(F.max("ts")).first()[0]
    assert 0 < first.count() and first.agg(F.max("ts")).first()[0] <= newest - timedelta(hours=12)
    take(df.where(at_hand >= cut))
    take(beat)
    got = take(late)
    flag = F.abs("imbl_price") > 100
    want = windows.run_position(df, QUARTER, flag, "consecutive_stress")
    want = windows.since_last(want, QUARTER, flag, "periods_since_stress").drop("imbl_price")
    want = want.withColumn("consecutive_stress", F.col("consecutive_stress").cast("long"))
    assert same_rows(got, want)
    counted = spark.read.parquet(side).drop("_batch").collect()
    assert [(r.zone, r.n, r.first_ts, r.last_ts) for r in counted] == [("A", 2, at(0).replace(tzinfo=None), at(1).replace(tzinfo=None))]


def test_open_windows_are_in_the_answer(spark, tmp_path):
    df = wave_frame(spark, 200).select("zone", "ts", "imbl_price")
    cut = F.lit("2025-01-02 00:20:00").cast("timestamp")
    for part in (df.where(F.col("ts") < cut), df.where(F.col("ts") >= cut)):
        stats = jobs.stream_stats(_land(spark, part, str(tmp_path / "in")), "imbl_price", "1 hour")
        jobs.run_to_upsert(stats, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = jobs.upserted(spark, str(tmp_path / "out"), stats.schema, ["zone", "ts"]).drop("until")
    want = df.groupBy("zone", F.date_trunc("hour", "ts").alias("ts")).agg(
        F.avg("imbl_price").alias("mean"), F.min("imbl_price").alias("low"), F.max("imbl_price").alias("high"), F.count("imbl_price").alias("n")
    )
    assert same_rows(got, want)


def test_ledger_names_what_is_in(spark, tmp_path):
    land, store = tmp_path / "land", Store(spark, str(tmp_path / "t"))
    land.mkdir()
    rec = lambda k, p: {"timestampUTC": f"2025-01-01T0{k}:00:00Z", "imblSalesPrice": p}
    seen = []

    def parse(payloads):
        seen.append(payloads.count())
        return feeds.parse_imbalance(payloads)

    def go(ckpt):
        src = jobs.stream_payloads(spark, str(land), "SE3")
        jobs.stream_ingest(src, store, "imbalance_prices", parse, str(tmp_path / ckpt)).awaitTermination()

    (land / "a.json").write_text(json.dumps([rec(0, 1), rec(1, 2)]))
    # A stream that died between its rows and its entry.
    store.insert_ignore("imbalance_prices", feeds.parse_imbalance(feeds.payloads(spark, str(land), "SE3")))
    go("c1")
    (land / "b.json").write_text(json.dumps([rec(2, 3)]))
    go("c1")
    go("c2")  # a lost checkpoint: all files come again
    assert seen == [1, 1, 0]
    assert values(store.scan("imbalance_prices"), "imbl_price") == [1.0, 2.0, 3.0]
    rows = sorted((r.feed, r.file.rsplit("/")[-1], r.rows, r.last_ts.hour) for r in store.ledger().collect())
    assert rows == [("imbalance_prices", "a.json", 2, 1), ("imbalance_prices", "b.json", 1, 2)]


def test_scoring_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    actual = A.prices(spark, sf).withColumnRenamed("price_eur_mwh", "y")
    runs = A.forecast_runs(spark, sf)
    out = str(tmp_path / "out")
    src = _land(spark, actual, str(tmp_path / "in"))
    jobs.stream_score(src, runs, str(tmp_path / "c"), lambda d: d.write.mode("append").parquet(out)).awaitTermination()
    want = asof_row(actual, runs, ["p05", "p50", "p95"], how="inner").withColumn("error", F.col("p50") - F.col("y"))
    assert same_rows(spark.read.parquet(out), want)
