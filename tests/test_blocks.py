"""Cut series give the rows of uncut ones, whatever the block length."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.features.imbalance import imbalance_features
from gridtide.operators import grid, joins, windows
from gridtide.operators.blocks import QUARTER
from gridtide.session import materialize
from tests.helpers import at, close, same_rows, series, values, wave_frame
from tests.test_plans import plan

SMALL, WHOLE = QUARTER.cut(37), QUARTER.cut(10**9)

OPERATORS = {
    "ffill": lambda d, s: grid.ffill(d, s, ["imbl_price"]),
    "ffill_limit": lambda d, s: grid.ffill(d, s, ["imbl_price", "direction"], limit=3),
    "lag": lambda d, s: windows.lag(d, s, "imbl_price", [1, 16, 96]),
    "lead": lambda d, s: windows.lead(d, s, "imbl_price", 4, "t"),
    "rolling": lambda d, s: windows.rolling(d, s, "imbl_price", 16, ["mean", "std", "max", "min", "sum"]),
    "wide_mean": lambda d, s: windows.rolling(d, s, "windspeed_100m", 96, ["mean"], 12, wide=True),
    "streak": lambda d, s: windows.streak(d, s, "direction", "n"),
    "run_position": lambda d, s: windows.run_position(d, s, F.abs("imbl_price") > 100, "n", 1),
    "since_last": lambda d, s: windows.since_last(d, s, F.abs("imbl_price") > 200, "n", 1),
    "since_never": lambda d, s: windows.since_last(d, s, F.col("imbl_price") > 1e9, "n", 1),
    "flips": lambda d, s: windows.flip_counts(d, s, "direction", [4, 16]),
    "near": lambda d, s: windows.near(d, s, F.abs("imbl_price") > 200),
    "segments": lambda d, s: windows.segments(
        d.withColumn("l", F.when(F.col("imbl_price") > 0, "up").otherwise("down")), s, "l"
    ),
    "gaps": lambda d, s: grid.interior_gaps(d.where(F.col("imbl_price").isNotNull()), s),
    "densify": lambda d, s: grid.densify(d.where(F.col("imbl_price").isNotNull()), s),
}


@pytest.fixture(scope="module")
def frame(spark):
    return wave_frame(spark, 400).cache()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_cut_equals_whole(frame, name):
    op = OPERATORS[name]
    assert same_rows(op(frame, SMALL), op(frame, WHOLE))


def plain_ewm(prices, span=8):
    a, y, w, out = 2 / (span + 1), None, 0.0, []
    for x in prices:
        w *= 1 - a
        if x is not None:
            y = x if y is None else (w * y + a * x) / (w + a)
            w = 1.0
        out.append(y)
    return out


def test_ewm_over_holes_of_every_length_at_a_block_edge(spark):
    # One series per hole length; holes start before an edge, end after it, or span blocks.
    rng = np.random.default_rng(5)
    rows, want, edge = [], {}, 300
    for k, hole in enumerate([*range(1, 60), *range(60, 3000, 97)]):
        start = edge - int(rng.integers(0, min(hole, 290) + 1))
        n = start + hole + int(rng.integers(3, 500))
        prices = [None if start <= i < start + hole else float(rng.normal(50, 30)) for i in range(n)]
        want[f"S{k:03}"] = plain_ewm(prices)
        rows += [(f"S{k:03}", 900 * i, p) for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, "zone string, sec long, imbl_price double").select(
        "zone", F.timestamp_seconds("sec").alias("ts"), "imbl_price"
    )
    for block in (300, 2880):
        got = windows.ewm(df, QUARTER.cut(block), "imbl_price", "e").orderBy("zone", "ts").toPandas()
        for zone, one in got.groupby("zone"):
            assert np.allclose(one["e"].to_numpy(dtype=float), np.array(want[zone], dtype=float), rtol=1e-12), (block, zone)


def test_ewm_over_rows_that_are_missing_and_sparse_values(spark):
    rng = np.random.default_rng(6)
    prices = [float(rng.normal(50, 30)) if rng.random() < 0.02 else None for _ in range(9000)]
    rows = [("A", 900 * i, p) for i, p in enumerate(prices) if p is not None or rng.random() < 0.5]
    df = spark.createDataFrame(rows, "zone string, sec long, imbl_price double").select(
        "zone", F.timestamp_seconds("sec").alias("ts"), "imbl_price"
    )
    want = plain_ewm(prices)
    for block in (40, 700, 2880):
        got = windows.ewm(df, QUARTER.cut(block), "imbl_price", "e").orderBy("ts").collect()
        for r, (_, sec, _) in zip(got, rows):
            w = want[sec // 900]
            assert (r.e is None) == (w is None) and (w is None or math.isclose(r.e, w, rel_tol=1e-12))


def test_matrix_mean_over_a_hole_longer_than_any_halo(spark):
    n = 2500
    price = [float(100 + i % 7) if i < 380 or i > 1700 else None for i in range(n)]
    df = series(spark, {"imbl_price": price, "direction": [1] * n})
    got = values(imbalance_features(df, s=QUARTER.cut(400)), "imbl_ewa")
    want = [None, *plain_ewm(price)[:-1]]
    assert close(got, want)


def test_segments_end_at_holes_on_and_off_a_block_edge(spark):
    for first, hole in [(40, 7), (44, 6), (43, 7), (10, 1), (49, 1), (50, 1), (20, 200)]:
        slots = [*range(first), *range(first + hole, first + hole + 30)]
        df = spark.createDataFrame([("A", 900 * i, "x") for i in slots], "zone string, sec long, label string")
        df = df.select("zone", F.timestamp_seconds("sec").alias("ts"), "label")
        got = windows.segments(df, QUARTER.cut(50), "label").orderBy("start").collect()
        assert [r.slots for r in got] == [first, 30], (first, hole)


def test_intervals_cut_equal_whole(spark):
    rows = [("A", f"2025-01-0{d} 0{h}:07:00", f"2025-01-0{d + 1} 0{h}:20:00", float(10 * d + h), h % 2 == 0)
            for d in range(1, 6) for h in range(1, 9)]
    iv = spark.createDataFrame(rows, "zone string, start string, end string, mw double, un boolean")
    iv = iv.withColumns({c: F.col(c).cast("timestamp") for c in ("start", "end")})
    go = lambda s: grid.expand_intervals(
        iv, s, "mw", "start", "end", "2025-01-01", "2025-01-08", {"all": F.lit(True), "un": F.col("un")}
    )
    assert same_rows(go(SMALL), go(WHOLE))


def test_feature_matrix_cut_equals_whole(frame):
    a = imbalance_features(frame, s=QUARTER.cut(150))
    b = imbalance_features(frame, s=QUARTER.cut(2500))
    assert a.count() == frame.count()
    assert same_rows(a, b, 6)


def test_ewm_of_wide_spans_over_many_blocks(spark):
    """One value per block of 2,880 slots: the mean reaches back over all of them."""
    rng = np.random.default_rng(2)
    n, step = 400, 2880
    known = (100 + rng.normal(0, 20, n)).tolist()
    rows = [("A", at(k * step), v) for k, v in enumerate(known)]
    df = spark.createDataFrame(rows, "zone string, ts timestamp, imbl_price double")
    for span in (8, 5001, 20001):
        a, want, y = 2 / (span + 1), [], None
        w = (1 - a) ** step
        for v in known:
            y = v if y is None else (w * y + a * v) / (w + a)
            want.append(y)
        got = [r.e for r in windows.ewm(df, QUARTER, "imbl_price", "e", span).orderBy("ts").collect()]
        assert np.allclose(got, want, rtol=1e-9)


def test_sweep_blocks_have_equal_depth(spark):
    """A burst within a minute and one stray time still end in many blocks."""
    burst = spark.range(200_000).select(F.lit("A").alias("zone"), (F.col("id") * 300 + 10**12).alias("_t"))
    stray = spark.createDataFrame([("A", 0), ("B", 5)], "zone string, _t long")
    blocks = joins._blocked(burst.unionByName(stray), ["zone"], 5_000).groupBy("zone", "_blk").count().collect()
    sizes = [r["count"] for r in blocks if r.zone == "A"]
    assert len(sizes) >= 40 and max(sizes) <= 10_000 and sum(sizes) == 200_001
    assert [r["count"] for r in blocks if r.zone == "B"] == [1]
    cut = joins._blocked(burst, ["zone"], 100).groupBy("_blk").agg(F.min("_t").alias("a"), F.max("_t").alias("b"), F.count("*").alias("n"))
    cut = cut.orderBy("_blk").collect()
    assert all(x.b < y.a for x, y in zip(cut, cut[1:])) and max(r.n for r in cut) <= 400


def test_interval_sums_return_to_zero(spark):
    iv = spark.range(50_000).select(
        F.lit("A").alias("zone"), (F.col("id") % 7 / 10 + 0.1).alias("mw"),
        F.timestamp_seconds(1735689600 + F.col("id") % 400 * 900).alias("start"),
        F.timestamp_seconds(1735689600 + (F.col("id") % 400 + F.col("id") % 90 + 1) * 900).alias("end"),
    )
    outside = spark.createDataFrame([("B", 5.0, at(-50), at(-40))], "zone string, mw double, start timestamp, end timestamp")
    got = grid.expand_intervals(
        iv.unionByName(outside), QUARTER.cut(96), "mw", "start", "end", "2025-01-01", "2025-01-08", {"all": F.lit(True), "none": F.lit(False)}
    ).toPandas()
    a = got[got["zone"] == "A"].sort_values("ts")["all"].to_numpy()
    want = np.zeros(673, dtype=np.int64)
    for i in range(50_000):
        want[i % 400 : i % 400 + i % 90 + 1] += i % 7 + 1
    assert (a == want / 10).all() and (a[495:] == 0).all()
    assert (got[got["zone"] == "B"]["all"] == 0).all() and len(got) == 2 * 673 and (got["none"] == 0).all()


def test_medians_of_many_columns_in_one_pass(spark):
    rng = np.random.default_rng(6)
    data = {f"c{i}": [None if rng.random() < 0.3 else float(v) for v in rng.normal(0, 10, 200)] for i in range(6)}
    data["c6"] = [None] * 199 + [3.0]
    df = materialize(series(spark, data))
    out = grid.fill_median(df, list(data))
    got = out.orderBy("ts").toPandas()
    for c, v in data.items():
        med = float(np.median([x for x in v if x is not None]))
        assert np.allclose(got[c], [med if x is None else x for x in v])
    assert len(re.findall("FileScan", plan(out))) <= 4  # for one column as for many
