"""Registered streaming queries: each stream runs to its end over the driver's tables."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from gridtide.catalog import sql_parts as P
from gridtide.catalog.core import query
from gridtide.plans import adapters as A
from gridtide.session import materialize, scratch_path
from gridtide.sources import feeds
from gridtide.sources.tables import Store
from gridtide.streaming import jobs


def _event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(
        F.concat(F.lit("Z"), F.col("user_id") % 4).alias("zone"), F.col("ts").cast("timestamp").alias("ts"), "value"
    )


def _windows(spark, stats):
    base = scratch_path(spark, "stream")
    jobs.run_to_upsert(stats, f"{base}/out", f"{base}/ckpt").awaitTermination()
    return jobs.upserted(spark, f"{base}/out", stats.schema, ["zone", "ts"])


@query(
    "streaming_hourly",
    "zone:s ts:t mean:d low:d high:d n:i",
    P.with_parts(P.EVENTS)
    + """SELECT zone, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(value) AS mean, min(value) AS low,
      max(value) AS high, count(value) AS n FROM ev GROUP BY ALL""",
)
def streaming_hourly(spark, sf):
    return _windows(spark, jobs.stream_stats(_event_stream(spark, sf), "value", "1 hour", delay="1 hour"))


@query(
    "streaming_daily_sliding",
    "zone:s ts:t mean:d low:d high:d n:i",
    P.with_parts(P.EVENTS)
    + """, s AS (SELECT zone, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(back) AS ts, value
      FROM ev, (SELECT CAST(range AS INT) AS back FROM range(24)))
    SELECT zone, ts, avg(value) AS mean, min(value) AS low, max(value) AS high, count(value) AS n FROM s GROUP BY ALL""",
)
def streaming_daily_sliding(spark, sf):
    return _windows(spark, jobs.stream_stats(_event_stream(spark, sf), "value", "24 hours", "1 hour", delay="1 hour"))


@contextmanager
def _rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, jobs.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


CHUNK_DAYS = 5


def shuffled_arrivals(spark, rows, folder):
    """Land rows (zone, ts, imbl_price) in files by their arrival, up to 12 hours after
    their time, and a last row without a zone that moves the watermark past all of them."""
    late = F.make_dt_interval(mins=F.pmod(F.xxhash64("zone", "ts"), F.lit(720)).cast("int"))
    chunk = F.floor(F.unix_seconds(F.col("ts") + late) / (CHUNK_DAYS * 86400))
    rows = materialize(rows.withColumn("chunk", chunk), "arrivals")
    for r in rows.select("chunk").distinct().orderBy("chunk").collect():
        rows.where(F.col("chunk") == r.chunk).drop("chunk").coalesce(1).write.mode("append").parquet(folder)
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    last = end.select(F.lit(None).cast("string").alias("zone"), "ts", F.lit(None).cast("double").alias("imbl_price"))
    last.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.drop("chunk").schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query(
    "streaming_stress",
    "zone:s ts:t consecutive_stress:i periods_since_stress:i",
    P.with_parts(P.EVENTS, P.IMBALANCE, P.DENSE_IMBALANCE)
    + """, n AS (SELECT zone, ts, CASE WHEN abs(imbl_price) > 200 THEN 1 ELSE 0 END AS s, row_number() OVER w AS rn
      FROM dimb WINDOW w AS (PARTITION BY zone ORDER BY ts)),
    c AS (SELECT *, CASE WHEN s = lag(s) OVER w THEN NULL ELSE rn END AS turned FROM n WINDOW w AS (PARTITION BY zone ORDER BY ts))
    SELECT zone, ts, (rn - max(turned) OVER w) * s AS consecutive_stress,
      rn - coalesce(max(CASE WHEN s = 1 THEN rn END) OVER w, 0) AS periods_since_stress
    FROM c WINDOW w AS (PARTITION BY zone ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
)
def streaming_stress(spark, sf):
    """Stress runs of rows that arrive up to 12 hours late and out of order."""
    base = scratch_path(spark, "stream")
    rows = A.dense_imbalance(spark, sf).select("zone", "ts", "imbl_price")
    arriving = shuffled_arrivals(spark, rows, f"{base}/in")
    with _rocksdb(spark):
        live = jobs.stream_stress(arriving)
        jobs.split_late(live, f"{base}/out", f"{base}/late", f"{base}/ckpt").awaitTermination()
    return spark.read.schema(live.drop("late").schema).parquet(f"{base}/out")


@query(
    "streaming_dedup",
    "zone:s ts:t",
    P.with_parts(P.EVENTS) + "SELECT DISTINCT zone, time_bucket(INTERVAL 1 HOUR, ts) AS ts FROM ev",
)
def streaming_dedup(spark, sf):
    """One row per zone and hour, whichever came first."""
    base = scratch_path(spark, "stream")
    hourly = _event_stream(spark, sf).select("zone", F.date_trunc("hour", "ts").alias("ts"))
    jobs.run_to_table(jobs.stream_dedup(hourly), f"{base}/out", f"{base}/ckpt").awaitTermination()
    return spark.read.schema(hourly.schema).parquet(f"{base}/out")


@query(
    "streaming_scores",
    "zone:s ts:t y:d p05:d p50:d p95:d error:d",
    P.with_parts(P.EVENTS, P.PRICES, P.RUNS)
    + """, best AS (SELECT * FROM fc WHERE generated_at <= ts
      QUALIFY row_number() OVER (PARTITION BY zone, ts ORDER BY generated_at DESC) = 1)
    SELECT pr.zone, pr.ts, price_eur_mwh AS y, p05, p50, p95, p50 - price_eur_mwh AS error
    FROM pr JOIN best ON pr.zone = best.zone AND pr.ts = best.ts""",
)
def streaming_scores(spark, sf):
    """Arriving prices scored with the newest forecast made in time."""
    base = scratch_path(spark, "stream")
    actual = A.prices(spark, sf).withColumnRenamed("price_eur_mwh", "y")
    actual.write.parquet(f"{base}/in")
    arriving = spark.readStream.schema(actual.schema).parquet(f"{base}/in")
    sink = lambda d: d.write.mode("append").parquet(f"{base}/out")
    jobs.stream_score(arriving, materialize(A.forecast_runs(spark, sf), "runs"), f"{base}/ckpt", sink).awaitTermination()
    return spark.read.parquet(f"{base}/out")


def land_payloads(spark, sf, folder):
    """The price table as payload files, one per zone and day, under zone folders."""
    rows = A.imbalance(spark, sf)
    fields = {v: k for k, v in feeds.IMBALANCE_FIELDS.items()}
    record = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestampUTC"),
        F.col("direction").cast("string").alias("mainDirRegPowerPerMBA"),
        *[F.col(c).alias(f) for c, f in fields.items()],
    )
    day = F.to_date("ts").alias("_day")
    # A day of a zone is at most 96 records.
    files = rows.groupBy("zone", day).agg(F.to_json(F.collect_list(record)).alias("value")).drop("_day")
    files.write.option("maxRecordsPerFile", 1).partitionBy("zone").text(folder)
    raw = spark.readStream.schema("value string, zone string").option("wholetext", True).text(folder)
    return raw.select("zone", F.col("_metadata.file_path").alias("source"), F.col("value").alias("payload"))


@query(
    "streaming_ingest",
    "zone:s ts:t imbl_price:d direction:i imbl_spot_diff:d up_reg_price:d down_reg_price:d",
    P.with_parts(P.EVENTS, P.IMBALANCE) + "SELECT * FROM imb",
)
def streaming_ingest(spark, sf):
    """Landed payload files into the stored table, by way of its ledger."""
    base = scratch_path(spark, "stream")
    store = Store(spark, f"{base}/tables")
    landed = land_payloads(spark, sf, f"{base}/in")
    jobs.stream_ingest(landed, store, "imbalance_prices", feeds.parse_imbalance, f"{base}/ckpt").awaitTermination()
    return store.scan("imbalance_prices")
