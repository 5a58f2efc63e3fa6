"""Structured Streaming jobs.

Each mirrors a batch operator: with all input at hand (``availableNow``) the result
equals the batch one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridtide.functions.scalars import STRESS_HIGH
from gridtide.operators.joins import asof_row
from gridtide.sources.tables import Store


def stream_payloads(spark: SparkSession, path: str, zone: str) -> DataFrame:
    """Newly landed payload files as (zone, source, payload) rows."""
    raw = spark.readStream.schema("value string").option("wholetext", True).text(path)
    return raw.select(
        F.lit(zone).alias("zone"), F.col("_metadata.file_path").alias("source"),
        F.col("value").alias("payload"),
    )


def stream_ingest(
    landed: DataFrame, store: Store, table: str, parse: Callable[[DataFrame], DataFrame],
    checkpoint: str, available_now: bool = True,
) -> StreamingQuery:
    """Landed payloads into a typed table.  Each batch is an insert-or-ignore followed by
    an entry in the store's ledger, so a batch repeated after a failure changes nothing
    and files that are in are not parsed again, even by a stream that starts anew."""

    def put(batch: DataFrame, number: int) -> None:
        store.take_in(table, batch, parse, number)

    writer = landed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_dedup(
    df: DataFrame, delay: str = "12 hours", keys: Sequence[str] = ("zone",), ts: str = "ts"
) -> DataFrame:
    """The first arrival of each (keys, ts) within the settlement lag."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys, ts])


def stream_stats(
    df: DataFrame, value: str, length: str = "1 hour", slide: str | None = None,
    delay: str = "12 hours", keys: Sequence[str] = ("zone",), ts: str = "ts",
) -> DataFrame:
    """Mean, extremes and count per tumbling or sliding window of event time."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return (
        df.withWatermark(ts, delay)
        .groupBy(*keys, w.alias("w"))
        .agg(
            F.avg(value).alias("mean"), F.min(value).alias("low"),
            F.max(value).alias("high"), F.count(value).alias("n"),
        )
        .select(*keys, F.col("w.start").alias(ts), F.col("w.end").alias("until"), "mean", "low", "high", "n")
    )


STRESS_STATE = "run long, since long, flag boolean, last_us long"
STRESS_OUTPUT = T.StructType(
    [
        T.StructField("zone", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("consecutive_stress", T.LongType()),
        T.StructField("periods_since_stress", T.LongType()),
        T.StructField("late", T.BooleanType()),
    ]
)


class StressTracker(StatefulProcessor):
    """Per zone: position in the current stress run and rows since the last stress.

    Rows wait in a map by time until the watermark has passed them; a timer at the first
    of them settles, in time order, all that it has passed.  What is settled is four
    numbers, so the state is the rows of the allowed delay.  A repeated row replaces the
    one that waits; a row that comes when its time is settled is returned as ``late``.
    Rows without a zone only move the watermark.
    """

    def __init__(self, limit: float = STRESS_HIGH):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stress", STRESS_STATE)
        self.waiting = handle.getMapState("waiting", "us long", "price double")

    def _numbers(self) -> tuple:
        return self.state.get() if self.state.exists() else (0, 0, None, None)

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        late, first = [], None
        settled = self._numbers()[3]
        for chunk in rows:
            if key[0] is None:
                continue
            for us, price in zip(chunk["us"].tolist(), chunk["price"].tolist()):
                if settled is not None and us <= settled:
                    late.append(us)
                    continue
                self.waiting.updateValue((us,), (None if pd.isna(price) else price,))
                first = us if first is None else min(first, us)
        if first is not None:
            self._wake(first)
        yield self._out(key[0], late, None, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        run, since, flag, last = self._numbers()
        times, now, out = [], [], []
        waiting = sorted((k[0], v[0]) for k, v in self.waiting.iterator())
        for us, price in waiting:
            if us > passed:
                self._wake(us)
                break
            self.waiting.removeKey((us,))
            hit = price is not None and abs(price) > self.limit
            run = run + 1 if hit == flag else 0
            since = 0 if hit else since + 1
            flag, last = hit, us
            times.append(us)
            now.append(run if hit else 0)
            out.append(since)
        if times:
            self.state.update((int(run), int(since), bool(flag), int(last)))
        yield self._out(key[0], times, now, out)

    def _out(self, zone: str | None, us: list[int], run: list[int] | None, since: list[int] | None) -> pd.DataFrame:
        none = [None] * len(us)
        return pd.DataFrame(
            {
                "zone": pd.Series([zone] * len(us), dtype=object), "ts": pd.to_datetime(us, unit="us"),
                "consecutive_stress": pd.array(none if run is None else run, dtype="Int64"),
                "periods_since_stress": pd.array(none if since is None else since, dtype="Int64"),
                "late": pd.Series([run is None] * len(us), dtype=bool),
            }
        )

    def close(self) -> None:
        pass


def stream_stress(
    df: DataFrame, price: str = "imbl_price", limit: float = STRESS_HIGH, delay: str = "12 hours"
) -> DataFrame:
    """Live stress runs of rows (zone, ts, price) that come in any order within ``delay``;
    with ``late`` rows, which came after their time was settled and count for nothing.

    Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    # The time goes in as a plain number: Spark would drop late rows by the column itself.
    rows = df.withWatermark("ts", delay).select(
        "zone", F.unix_micros("ts").alias("us"), F.col(price).cast("double").alias("price")
    )
    return rows.groupBy("zone").transformWithStateInPandas(
        StressTracker(limit), outputStructType=STRESS_OUTPUT, outputMode="append", timeMode="eventTime"
    )


def split_late(df: DataFrame, path: str, late_path: str, checkpoint: str) -> StreamingQuery:
    """Settled rows into one table; per batch and zone the number and the span of late rows
    into another.  A batch written again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.persist()  # two writes of one batch
        rows.where("not late").drop("late").write.mode("overwrite").parquet(f"{path}/_batch={number}")
        counted = rows.where("late").groupBy("zone").agg(
            F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
        )
        counted.write.mode("overwrite").parquet(f"{late_path}/_batch={number}")
        rows.unpersist()

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_score(
    actuals: DataFrame, runs: DataFrame, checkpoint: str, sink: Callable[[DataFrame], None],
    available_now: bool = True,
) -> StreamingQuery:
    """Score each arriving actual (zone, ts, y) with the newest forecast made in time.

    The forecast table is read anew for each batch, so runs added meanwhile count.
    """

    def score(batch: DataFrame, _: int) -> None:
        out = asof_row(batch, runs, ["p05", "p50", "p95"], how="inner")
        sink(out.withColumn("error", F.col("p50") - F.col("y")))

    writer = actuals.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )



def run_to_upsert(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows that change while their window is open, in update mode: every batch writes the
    rows it changed under its number (written again, it replaces itself); ``upserted``
    reads the newest of each key.  So open windows are in the answer as they stand."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={number}")

    writer = df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update")
    return writer.trigger(availableNow=True).start()


def upserted(spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str]) -> DataFrame:
    """The newest row of each key of what ``run_to_upsert`` wrote."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])).parquet(path)
    rest = [c for c in schema.names if c not in key]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("_r"))
    return newest.select(*key, "_r.*").select(*schema.names)
