"""Keyed tables as partitioned Parquet: scans, upserts, tails and coverage.

Spark does not enforce keys; ``insert_ignore`` and ``insert_replace`` keep them unique
under a single writer per table.

A table is a folder of loads, each partitioned by zone and year, and a numbered list of
the (load, zone, year) folders in force.  A write adds a load and then the next list; the
list appears at once under its number, so a reader sees the table before or after a write,
never between, and a write that died leaves nothing that is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.operators.grid import dedup
from gridtide.operators.projections import align_schema
from gridtide.schemas import SCHEMAS, TableDef

PART = "year"
LOAD = "load"
Leaf = tuple[str, str, int]  # load, zone, year


@dataclass(frozen=True)
class Store:
    """A folder of tables, each partitioned by zone and year."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def table_def(self, name: str) -> TableDef:
        return SCHEMAS[name]

    # --- which folders are in force ---

    def _lists(self, name: str):
        """Folder of the numbered lists and its file system."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_state")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        at, files = self._lists(name)
        if not files.exists(at):
            return []
        names = [f.getPath().getName() for f in files.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit())

    def exists(self, name: str) -> bool:
        return bool(self._numbers(name))

    def _leaves(self, name: str) -> list[Leaf]:
        """The folders of the newest list: as many as zones, years and loads since the
        last rewrite."""
        numbers = self._numbers(name)
        if not numbers:
            raise AnalysisException(f"table {name} does not exist under {self.root}")
        text = self.spark.read.text(f"{self.path(name)}/_state/{numbers[-1]:010d}")
        rows = text.where("value <> ''").select(F.split("value", "\t").alias("x")).collect()
        return [(r.x[0], r.x[1], int(r.x[2])) for r in rows]

    def _commit(self, name: str, leaves: Iterable[Leaf]) -> None:
        """Make a list of folders the table.  The rename fails if another writer was faster."""
        at, files = self._lists(name)
        number = (self._numbers(name) or [0])[-1] + 1
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        made, final = path(at, f"new-{uuid.uuid4().hex}"), path(at, f"{number:010d}")
        out = files.create(made)
        out.write(bytearray("".join(f"{a}\t{z}\t{y}\n" for a, z, y in sorted(leaves)).encode()))
        out.close()
        if files.exists(final) or not files.rename(made, final):
            files.delete(made, False)
            raise RuntimeError(f"table {name} was written by somebody else; read it again")

    def _folder(self, name: str, leaf: Leaf) -> str:
        load, zone, year = leaf
        names = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        return f"{self.path(name)}/{LOAD}={load}/zone={names.escapePathName(zone)}/{PART}={year}"

    def _read(self, name: str, leaves: Sequence[Leaf]) -> DataFrame:
        d = self.table_def(name)
        schema = T.StructType([*d.schema.fields, T.StructField(PART, T.IntegerType()), T.StructField(LOAD, T.StringType())])
        if not leaves:
            return self.spark.createDataFrame([], schema).drop(LOAD)
        reader = self.spark.read.schema(schema).option("basePath", self.path(name))
        return reader.parquet(*[self._folder(name, x) for x in leaves]).drop(LOAD)

    def ensure_tables(self) -> None:
        """Create every table that is missing, empty and with its schema."""
        for name in SCHEMAS:
            if not self.exists(name):
                self._commit(name, [])

    # --- reading ---

    def scan(
        self,
        name: str,
        start: str | Column | None = None,
        end: str | Column | None = None,
        cols: Sequence[str] | None = None,
        ordered: bool = False,
    ) -> DataFrame:
        """Rows in the closed range; the bounds prune year folders and row groups."""
        df = self._read(name, self._leaves(name))
        for bound, lower in ((start, True), (end, False)):
            if bound is None:
                continue
            t = F.lit(bound).cast("timestamp") if isinstance(bound, str) else bound
            cond = F.col("ts") >= t if lower else F.col("ts") <= t
            part = F.col(PART) >= F.year(t) if lower else F.col(PART) <= F.year(t)
            df = df.where(cond & part)
        df = df.drop(PART)
        if cols is not None:
            df = df.select(*cols)
        return df.orderBy("ts") if ordered else df

    def scan_optional(self, name: str) -> DataFrame:
        """The table, or an empty frame of its schema."""
        if self.exists(name):
            return self.scan(name)
        return self.spark.createDataFrame([], self.table_def(name).schema)

    # --- writing ---

    def _load(self, df: DataFrame, name: str) -> list[Leaf]:
        """Write rows as a new load, not yet in force; the folders it has."""
        out = align_schema(df, self.table_def(name).schema).withColumn(PART, F.year("ts"))
        load = uuid.uuid4().hex
        path = f"{self.path(name)}/{LOAD}={load}"
        # Rebalancing splits a heavy zone over several writers and joins small ones.
        out.hint("rebalance", "zone", PART).write.partitionBy("zone", PART).parquet(path)
        jvm = self.spark.sparkContext._jvm
        names = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        made = self._lists(name)[1].globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/zone=*/{PART}=*"))
        leaves = [(f.getPath().getParent().getName(), f.getPath().getName()) for f in made or []]
        return [(load, names.unescapePathName(z.removeprefix("zone=")), int(y.removeprefix(f"{PART}="))) for z, y in leaves]

    def append(self, name: str, df: DataFrame) -> None:
        old = self._leaves(name) if self.exists(name) else []
        self._commit(name, [*old, *self._load(df, name)])

    def _touched(self, name: str, rows: DataFrame) -> tuple[list[Leaf], list[Leaf], tuple | None]:
        """The folders with years and zones of incoming rows, the others, and the rows'
        first and last time (None without rows)."""
        spans = rows.groupBy("zone", F.year("ts").alias(PART)).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()
        if not spans:
            return [], [], None
        met = {(r["zone"], r[PART]) for r in spans}
        leaves = self._leaves(name) if self.exists(name) else []
        inside = [x for x in leaves if (x[1], x[2]) in met]
        return inside, [x for x in leaves if x not in set(inside)], (min(r["lo"] for r in spans), max(r["hi"] for r in spans))

    def insert_ignore(self, name: str, df: DataFrame, order: Sequence[str] = ()) -> None:
        """Append rows with new keys; existing rows stay as they are.  Of the table only
        the incoming zones, years and time range are read."""
        d = self.table_def(name)
        rows = dedup(align_and_keep(df, d, order), list(d.key), list(order)).drop(*order)
        touched, others, span = self._touched(name, rows)
        if span is None:
            return
        have = self._read(name, touched).where(F.col("ts").between(*[F.lit(t) for t in span]))
        new = rows.join(have.select(*d.key), list(d.key), "left_anti")
        self._commit(name, [*others, *touched, *self._load(new, name)])

    def insert_replace(self, name: str, df: DataFrame, order: Sequence[str] = ()) -> None:
        """Incoming rows win.  Only the touched (zone, year) folders are read and written
        again; old and new ones change places in one list."""
        d = self.table_def(name)
        rows = dedup(align_and_keep(df, d, order), list(d.key), list(order), "last").drop(*order)
        touched, others, span = self._touched(name, rows)
        if span is None:
            return
        merged = merge_rows(self._read(name, touched).drop(PART), rows, d.key)
        self._commit(name, [*others, *self._load(merged, name)])

    def save_run(self, name: str, fc: DataFrame, generated_at: Column | None = None) -> None:
        """Stamp a forecast with its run time and add it under (ts, run)."""
        at = F.current_timestamp() if generated_at is None else generated_at
        self.insert_ignore(name, fc.withColumn("generated_at", at.cast("timestamp")))

    def save_predictions(self, name: str, scored: DataFrame, generated_at: Column | None = None) -> None:
        """Predictions of a test set (zone, ts, p05, p50, p95, ...) as one forecast run."""
        self.save_run(name, scored.select("zone", "ts", "p05", "p50", "p95"), generated_at)

    def get_threshold(self, default: float = 0.45) -> DataFrame:
        """The newest threshold row, or the default where none was ever set."""
        rows = self.scan_optional("thresholds")
        pick = F.coalesce(F.max_by("threshold", "ts"), F.lit(default))
        return rows.agg(pick.alias("threshold"), F.max("ts").alias("ts"), F.max_by("reason", "ts").alias("reason"))

    def set_threshold(self, decision: DataFrame) -> None:
        """Append a new threshold version for applied changes only."""
        changed = decision.where(F.col("decision") == "applied").select(
            "zone", "ts", F.col("recommended_threshold").alias("threshold"),
            F.col("reasoning").alias("reason"),
        )
        self.append("thresholds", changed)

    # --- what has been taken in ---

    def ledger(self) -> DataFrame:
        """(feed, file, batch, rows, last_ts): files taken in, with the rows and the last
        time of the batch they came in."""
        try:
            return self.spark.read.schema(LEDGER).parquet(f"{self.root.rstrip('/')}/_ledger")
        except AnalysisException:
            return self.spark.createDataFrame([], LEDGER)

    def take_in(self, name: str, landed: DataFrame, parse, batch: int = -1, replace: bool = False) -> None:
        """Landed payload rows (zone, source, payload) whose file the ledger does not name,
        parsed and put into a table; then the ledger names them.  Whatever dies in between
        is done again without effect, as rows are keyed."""
        known = self.ledger().where(F.col("feed") == name).select(F.col("file").alias("source"))
        new = landed.join(known, "source", "left_anti")
        rows = parse(new).persist()  # written, and counted for the ledger
        (self.insert_replace if replace else self.insert_ignore)(name, rows)
        size = rows.agg(F.count(F.lit(1)).alias("rows"), F.max("ts").alias("last_ts")).first()
        rows.unpersist()
        entry = new.select(
            F.lit(name).alias("feed"), F.col("source").alias("file"), F.lit(batch).cast("bigint").alias("batch"),
            F.lit(size["rows"]).cast("bigint").alias("rows"), F.lit(size["last_ts"]).cast("timestamp").alias("last_ts"),
        )
        entry.distinct().write.mode("append").parquet(f"{self.root.rstrip('/')}/_ledger")


LEDGER = "feed string, file string, batch bigint, rows bigint, last_ts timestamp"


def align_and_keep(df: DataFrame, d: TableDef, order: Sequence[str]) -> DataFrame:
    extra = [df.schema[c] for c in order if c not in d.schema.names]
    return align_schema(df, T.StructType([*d.schema.fields, *extra]))


def merge_rows(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows whose key is not among the new ones, plus the new ones."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)


def ignore_rows(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows plus the new ones whose key is not among them."""
    return old.unionByName(new.join(old.select(*key), list(key), "left_anti"))


def missing_tail(
    have: DataFrame, wanted: DataFrame, start: str, end: str, step: int, ts: str = "ts"
) -> DataFrame:
    """(keys, fetch_from, fetch_to) for each wanted key that lacks rows up to ``end``:
    the full range where it has none, else from one step after its last row."""
    keys = wanted.columns
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    last = have.groupBy(*keys).agg(F.max(ts).alias("_hi"))
    nxt = F.col("_hi") + F.make_dt_interval(secs=F.lit(step))
    return (
        wanted.join(last, list(keys), "left")
        .where(F.col("_hi").isNull() | (F.col("_hi") < hi))
        .select(*keys, F.coalesce(nxt, lo).alias("fetch_from"), hi.alias("fetch_to"))
    )


def refresh_window(df: DataFrame, now: Column, days: int = 16, ts: str = "ts") -> DataFrame:
    """The trailing days to take in again; idempotent with ``insert_ignore``."""
    return df.where((F.col(ts) > now - F.make_dt_interval(days=F.lit(days))) & (F.col(ts) <= now))


def coverage(tables: dict[str, DataFrame | None], ts: str = "ts") -> DataFrame:
    """First and last time and row count per table; a missing one shows zero rows."""

    def one(name: str, df: DataFrame | None) -> DataFrame:
        if df is None:
            spark = next(d for d in tables.values() if d is not None).sparkSession
            df = spark.createDataFrame([], "ts timestamp")
        return df.agg(
            F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n")
        ).select(F.lit(name).alias("table_name"), "first_ts", "last_ts", "n")

    return reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])


#: Feeds whose newer content replaces earlier rows.
MOVING = {"smhi_wind_forecast"}


def sync(store: Store, feeds: dict[str, DataFrame], landed: dict[str, tuple] | None = None) -> DataFrame:
    """Take each parsed feed into its table and report the coverage afterwards.

    Forecast feeds of moving content replace earlier rows, all others are added.
    ``landed``: payload rows and their parser by table; files that the ledger names are
    not parsed again.
    """
    for name, df in feeds.items():
        put = store.insert_replace if name in MOVING else store.insert_ignore
        put(name, df)
    for name, (payloads, parse) in (landed or {}).items():
        store.take_in(name, payloads, parse, replace=name in MOVING)
    return coverage({n: store.scan_optional(n) for n in [*feeds, *(landed or {})]})


def export_csv(df: DataFrame, path: str, digits: int = 2) -> None:
    """Write a range as CSV with its doubles rounded."""
    cols = [
        F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def save_metrics(df: DataFrame, path: str) -> None:
    df.withColumn("saved_at", F.current_timestamp()).write.mode("append").json(path)
