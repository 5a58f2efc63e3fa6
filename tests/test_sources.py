"""Landed files, upserts and table maintenance on real folders."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from gridtide.plans import evaluate
from gridtide.schemas import SCHEMAS
from gridtide.sources import feeds
from gridtide.sources.tables import Store, coverage, export_csv, missing_tail, save_metrics, sync
from tests.helpers import at, series, values


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def land(folder, payload, name=None):
    path = f"{folder}/{name or uuid.uuid4().hex}.json"
    with open(path, "w") as f:
        json.dump(payload, f)
    return path


def test_imbalance_envelopes_numbers_and_repeats(spark, folder):
    land(folder, [
        {"timestampUTC": "2025-01-01T00:00:00Z", "imblSalesPrice": 10.5, "mainDirRegPowerPerMBA": "Long", "upRegPrice": "7"},
        {"timestampUTC": "2025-01-01T00:15:00Z", "imblSalesPrice": "bad", "mainDirRegPowerPerMBA": 2},
    ], "a")
    land(folder, {"data": [{"timestampUTC": "2025-01-01T00:15:00Z", "imblSalesPrice": 99}, {"timestampUTC": "2025-01-01T00:30:00Z"}]}, "b")
    out = feeds.parse_imbalance(feeds.payloads(spark, folder, "SE3"))
    assert values(out, "imbl_price", "direction", "up_reg_price") == [(10.5, -1, 7.0), (None, 1, None), (None, 0, None)]


def test_local_times_of_the_autumn_hour_follow_the_order(spark, folder):
    local = ["01:45", "02:00", "02:15", "02:30", "02:45", "02:00", "02:15", "02:30", "02:45", "03:00"]
    land(folder, [{"timestamp": f"2025-10-26T{t}:00", "imblSalesPrice": k} for k, t in enumerate(local)])
    out = feeds.parse_imbalance(feeds.payloads(spark, folder, "SE3"))
    assert values(out, "imbl_price") == [float(k) for k in range(10)]
    gaps = out.orderBy("ts").select((F.unix_seconds("ts")).alias("u")).collect()
    assert {b.u - a.u for a, b in zip(gaps, gaps[1:])} == {900}


def test_offset_in_a_local_time_is_used(spark, folder):
    land(folder, [{"timestamp": "2025-06-01T12:00:00+02:00", "imblSalesPrice": 1}, {"timestamp": "2025-06-01T13:00:00", "imblSalesPrice": 2}])
    out = feeds.parse_imbalance(feeds.payloads(spark, folder, "SE3")).orderBy("ts")
    assert [r.u for r in out.select(F.date_format("ts", "HH:mm").alias("u")).collect()] == ["10:00", "11:00"]


def test_parallel_arrays_with_one_missing(spark, folder):
    land(folder, {"hourly": {"time": ["2025-01-01T00:00", "2025-01-01T01:00"], "wind_speed_10m": [1.0, None], "cloud_cover": [5.0]}})
    out = feeds.parse_hourly_arrays(feeds.payloads(spark, folder, "SE3"), feeds.FORECAST_FIELDS)
    assert values(out, "fcst_wind_10m", "fcst_cloud_cover", "fcst_wind_100m") == [(1.0, 5.0, None), (None, None, None)]


def test_point_series_per_location(spark, folder):
    import os
    for site, w, sym in (("a", 2.0, 3), ("b", 4.0, 1)):
        os.makedirs(f"{folder}/location={site}")
        land(f"{folder}/location={site}", {"timeSeries": [{"time": "2025-01-01T00:00:00Z", "data": {"wind_speed": w, "symbol_code": sym}}]})
    raw = feeds.payloads(spark, folder, "SE3")
    points = feeds.parse_point_series(raw, {**feeds.LOCATION_FIELDS, "symbol_code": "symbol_code"}, ["location"])
    row = feeds.location_means(points).first()
    assert (row.smhi_wind_speed_ms, row.smhi_symbol_code, row.smhi_temperature_c) == (3.0, 1.0, None)


def test_grid_series_end_is_exclusive(spark, folder):
    land(folder, {"start": 1735689600, "end": 1735700400, "interval": 3600, "variables": [[1, 2, 3], [4, 5, None]]})
    out = feeds.parse_grid_series(feeds.payloads(spark, folder, "SE3"), ["a", "b"])
    assert values(out, "a", "b") == [(1.0, 4.0), (2.0, 5.0), (3.0, None)]
    assert out.agg(F.min("ts")).first()[0].hour == at(0).hour


def test_outages_take_the_newest_revision(spark):
    rows = [
        ("A", "u1", 1, "Nuclear", "Planned maintenance", "1000", "0", "2025-01-01 00:00:00", "2025-01-01 01:00:00"),
        ("A", "u1", 2, "Nuclear", "Unplanned outage", "1000", "400", "2025-01-01 00:15:00", "2025-01-01 00:45:00"),
        ("A", "u2", 1, "NUCLEAR", None, "x", "50", "2025-01-01 00:00:00", "2025-01-01 01:00:00"),
        ("A", "u3", 1, "Hydro", None, "900", "0", "2025-01-01 00:00:00", "2025-01-01 01:00:00"),
        ("A", "u4", 1, None, None, "900", "0", "2025-01-01 00:00:00", "2025-01-01 01:00:00"),
    ]
    df = spark.createDataFrame(rows, "zone string, mrid string, revision int, plant_type string, businesstype string, "
                               "nominal_power string, avail_qty string, start string, end string")
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("start", "end")})
    out = feeds.nuclear_outages(df, "2025-01-01", "2025-01-01 01:00:00")
    assert values(out, "nuclear_unavail_mw", "nuclear_outage_flag") == [(0.0, 0), (600.0, 1), (600.0, 1), (0.0, 0), (0.0, 0)]


def test_generation_sources(spark):
    wind = series(spark, {"a": [1.0] * 8, "b": [2.0] * 8})
    mix = feeds.generation_mix(wind, None, series(spark, {"l": [10.0] * 4}))
    assert values(mix, "wind_gen_mw", "nuclear_cap_mw", "load_mw") == [(3.0, None, 10.0), (3.0, None, 10.0)]
    nuc = feeds.nuclear_actual(series(spark, {"Nuclear - Actual": [5.0] * 4 + [None] * 4 + [7.0] * 4}))
    assert values(nuc, "nuclear_gen_mw") == [5.0, 5.0, 7.0]
    with pytest.raises(ValueError):
        feeds.nuclear_actual(wind)
    fc = feeds.generation_forecast(series(spark, {"Solar": [1.0]}), "2025-01-01", "2025-01-01 02:00:00")
    assert values(fc, "solar_gen_forecast_mw") == [1.0] * 5 + [None] * 4
    assert values(fc, "wind_gen_forecast_mw") == [None] * 9


def _prices(spark, vals, start=0):
    rows = [("A", at(start + k, 60), v) for k, v in enumerate(vals)]
    return spark.createDataFrame(rows, "zone string, ts timestamp, price_eur_mwh double")


def test_insert_ignore_and_replace(spark, folder):
    store = Store(spark, folder)
    store.ensure_tables()
    assert all(store.exists(n) for n in SCHEMAS)
    store.insert_ignore("prices", _prices(spark, [1.0, 2.0, 3.0]))
    repeat = _prices(spark, [9.0, 9.0, 4.0, 5.0], start=1).unionByName(_prices(spark, [6.0], start=4))
    store.insert_ignore("prices", repeat)
    store.insert_ignore("prices", repeat)
    assert values(store.scan("prices"), "price_eur_mwh") == [1.0, 2.0, 3.0, 4.0, 5.0]
    store.insert_replace("prices", _prices(spark, [7.0, 8.0], start=4))
    assert values(store.scan("prices"), "price_eur_mwh") == [1.0, 2.0, 3.0, 4.0, 7.0, 8.0]
    part = store.scan("prices", "2025-01-01 02:00:00", "2025-01-01 03:00:00", ["zone", "ts", "price_eur_mwh"], ordered=True)
    assert values(part, "price_eur_mwh") == [3.0, 4.0]


def test_replace_leaves_other_years_alone(spark, folder):
    store = Store(spark, folder)
    old = spark.createDataFrame([("A", at(-9000, 60), 1.0)], "zone string, ts timestamp, price_eur_mwh double")
    store.insert_ignore("prices", old.unionByName(_prices(spark, [2.0])))
    store.insert_replace("prices", _prices(spark, [3.0]))
    assert values(store.scan("prices"), "price_eur_mwh") == [1.0, 3.0]


def test_scan_prunes_folders_and_pushes_time(spark, folder):
    store = Store(spark, folder)
    store.insert_ignore("prices", _prices(spark, [1.0]))
    plan = store.scan("prices", "2025-01-01", "2025-06-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "GreaterThanOrEqual(ts" in plan


def test_upserts_read_only_what_the_rows_touch(spark, folder, monkeypatch):
    store = Store(spark, folder)
    old = spark.createDataFrame([("A", at(-9000, 60), 1.0), ("B", at(0, 60), 2.0)], "zone string, ts timestamp, price_eur_mwh double")
    store.insert_ignore("prices", old.unionByName(_prices(spark, [3.0])))
    read, plans = Store._read, []

    def spied(self, name, leaves):
        plans.append(sorted((z, y) for _, z, y in leaves))
        return read(self, name, leaves)

    monkeypatch.setattr(Store, "_read", spied)
    store.insert_ignore("prices", _prices(spark, [9.0, 4.0]))
    store.insert_replace("prices", _prices(spark, [5.0], start=1))
    assert plans == [[("A", 2025)], [("A", 2025), ("A", 2025)]]
    assert values(store.scan("prices"), "price_eur_mwh") == [1.0, 3.0, 5.0, 2.0]
    store.insert_ignore("prices", _prices(spark, []))
    assert store.scan("prices").count() == 4


def test_readers_see_one_state(spark, folder, monkeypatch):
    store = Store(spark, folder)
    store.insert_ignore("prices", _prices(spark, [1.0]))
    before = store.scan("prices")
    store._load(_prices(spark, [7.0, 8.0]), "prices")  # a writer that died before its list
    assert values(store.scan("prices"), "price_eur_mwh") == [1.0]
    store.insert_replace("prices", _prices(spark, [2.0]))
    assert values(before, "price_eur_mwh") == [1.0] and values(store.scan("prices"), "price_eur_mwh") == [2.0]
    stale = [store._numbers("prices")[0]]
    monkeypatch.setattr(Store, "_numbers", lambda self, name: stale)
    with pytest.raises(RuntimeError, match="somebody else"):
        store.insert_replace("prices", _prices(spark, [3.0]))


def test_zones_with_odd_names(spark, folder):
    store = Store(spark, folder)
    rows = _prices(spark, [1.0, 2.0]).withColumn("zone", F.lit("S/E=3 x"))
    store.insert_ignore("prices", rows)
    store.insert_ignore("prices", rows)
    assert [(r.zone, r.price_eur_mwh) for r in store.scan("prices", ordered=True).collect()] == [("S/E=3 x", 1.0), ("S/E=3 x", 2.0)]


def test_sync_skips_files_in_the_ledger(spark, folder):
    store = Store(spark, folder + "/t")
    land_at = f"{folder}/in"
    os.makedirs(land_at)
    land(land_at, [{"timestampUTC": "2025-01-01T00:00:00Z", "imblSalesPrice": 1}], "a")
    seen = []

    def parse(payloads):
        seen.append(payloads.count())
        return feeds.parse_imbalance(payloads)

    for _ in range(2):
        rep = sync(store, {}, {"imbalance_prices": (feeds.payloads(spark, land_at, "SE3"), parse)})
    assert seen == [1, 0] and rep.first().n == 1


def test_missing_table_reads_empty(spark, folder):
    store = Store(spark, folder)
    assert store.scan_optional("weather").count() == 0
    row = coverage({"prices": _prices(spark, [1.0]), "weather": None}).where("table_name = 'weather'").first()
    assert row.n == 0 and row.first_ts is None


def test_runs_thresholds_and_log(spark, folder):
    store = Store(spark, folder)
    fc = _prices(spark, [1.0]).select("zone", "ts", *[F.lit(1.0).alias(c) for c in ("p05", "p50", "p95")])
    stamp = F.lit("2024-12-31 22:45:00").cast("timestamp")
    store.save_run("imbalance_forecasts", fc, stamp)
    store.save_run("imbalance_forecasts", fc, stamp)
    got = store.scan("imbalance_forecasts").collect()
    assert len(got) == 1 and got[0].spike_proba is None and got[0].regime is None
    assert store.get_threshold(0.45).first().threshold == 0.45
    sweep = spark.createDataFrame([(0.3, 0.5, 0.2, 0.29), (0.4, 0.2, 0.3, 0.2)], "threshold double, recall double, precision double, f2 double")
    rec = evaluate.recommend_threshold(sweep, 0.4).withColumns(
        {"zone": F.lit("A"), "ts": F.current_timestamp(), "reasoning": F.lit("sweep"), "confidence": F.lit("high")}
    )
    store.append("threshold_decisions", rec)
    store.set_threshold(rec)
    store.set_threshold(rec.withColumns({"decision": F.lit("rejected"), "recommended_threshold": F.lit(0.9)}))
    assert store.get_threshold().first().threshold == 0.3
    assert store.scan("threshold_decisions").count() == 1


def test_sync_tails_and_exports(spark, folder):
    store = Store(spark, folder + "/t")
    rep = sync(store, {"prices": _prices(spark, [1.0, 2.0])})
    assert rep.first().n == 2
    wanted = spark.createDataFrame([("A",), ("B",)], "zone string")
    tail = lambda end: {r.zone: r.fetch_from.hour for r in missing_tail(store.scan("prices"), wanted, "2025-01-01 00:00:00", end, 3600).collect()}
    assert tail("2025-01-02") == {"A": 2, "B": 0} and tail("2025-01-01 01:00:00") == {"B": 0}
    export_csv(_prices(spark, [1.239]), folder + "/csv")
    assert spark.read.option("header", True).csv(folder + "/csv").first().price_eur_mwh == "1.24"
    save_metrics(spark.createDataFrame([(1.0,)], "mae double"), folder + "/m")
    save_metrics(spark.createDataFrame([(2.0,)], "mae double"), folder + "/m")
    assert spark.read.json(folder + "/m").count() == 2
