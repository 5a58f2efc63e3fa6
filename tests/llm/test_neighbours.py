import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.llm.neighbours import nearest, prefix_ranges

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)


def brute(rows, is_query, k):
    fine = {}
    for i, v in rows:
        if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fine[i] = np.array(v, dtype=np.float32).astype(float)
    ids = sorted(fine)
    x = np.array([fine[i] for i in ids]).reshape(len(ids), 8)
    out = {}
    for i in ids:
        if is_query(i):
            s = np.zeros(len(ids))
            for j in range(8):
                s += x[:, j] * fine[i][j]
            out[i] = [(ids[n], s[n]) for n in np.lexsort((ids, -s)) if ids[n] != i][:k]
    return out


def rows_of(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, 8)) * 0.4
    x *= rng.uniform(0.3, 2, size=(n, 1))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(n + i, rows[7][1]) for i in range(60)]  # many copies of one vector
    rows += [(n + 60, None), (n + 61, []), (n + 62, [0.0] * 8), (n + 63, [math.nan] * 8), (n + 64, [math.inf] + [1.0] * 7)]
    rows += [(n + 65, [None] + [1.0] * 7), (n + 66, [1.0] * 3), (None, [1.0] * 8), (n + 68, [-0.0] + [1.0] * 7), (n + 70, [0.0] + [1.0] * 7)]
    return rows + [rows[3]]


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_prefix_ranges():
    a = np.sort(np.array([0b0000, 0b0101, 0b0110, 0b0111, 0b1000]))
    low, high = prefix_ranges(a, 0b0111, 4)
    assert (high - low).tolist() == [5, 4, 3, 2, 1]


def test_with_enough_candidates_the_result_is_exact(spark):
    rows = rows_of(400)
    got = collected(nearest(frame(spark, rows), F.col("vec_id") % 10 == 0, k=5, trees=4, candidates=10**9))
    want = brute(rows, lambda i: i % 10 == 0, 5)
    assert got == want


@pytest.mark.parametrize("shard", [1 << 16, 100])
def test_recall_and_bounded_shards(spark, shard):
    rows = rows_of(1500)
    got = collected(nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, k=10, trees=16, candidates=4000, shard=shard))
    want = brute(rows, lambda i: i % 20 == 0, 10)
    assert set(got) == set(want)
    recall = np.mean([len({a for a, _ in got[i]} & {a for a, _ in want[i]}) / 10 for i in want])
    assert recall >= (0.95 if shard > 100 else 0.8)


def test_the_ascent_goes_past_the_shard(spark):
    rows = rows_of(400)
    got = collected(nearest(frame(spark, rows), F.col("vec_id") % 10 == 0, k=5, trees=4, candidates=10**9, shard=50))
    assert got == brute(rows, lambda i: i % 10 == 0, 5)


def test_recall_does_not_fall_as_the_table_grows(spark):
    rng, recall = np.random.default_rng(3), []
    for n in (1000, 16_000):
        rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(n, 8)))]
        asked = F.col("vec_id") % (n // 50) == 0
        got = collected(nearest(frame(spark, rows), asked, k=10, trees=12, candidates=500, shard=1000, share=0.04))
        want = brute(rows, lambda i, n=n: i % (n // 50) == 0, 10)
        recall.append(np.mean([len({a for a, _ in got[i]} & {a for a, _ in want[i]}) / 10 for i in want]))
    assert min(recall) >= 0.9 and recall[1] >= recall[0] - 0.03, recall


def test_few_rows_and_no_rows(spark):
    rows = [(0, [1.0] * 8), (1, [2.0] * 8), (20, [1.0] * 8)]
    got = collected(nearest(frame(spark, rows), F.col("vec_id") % 20 == 0))
    assert got == {0: [(1, 16.0), (20, 8.0)], 20: [(1, 16.0), (0, 8.0)]}
    assert nearest(frame(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest(frame(spark, [(0, None)]), F.col("vec_id") % 20 == 0).collect() == []


def test_equal_scores_of_different_vectors_go_by_id(spark):
    """Every vector has the same product with the query, and ids run against their order."""
    rng = np.random.default_rng(5)
    rows = [(1000, [1.0] + [0.0] * 7)] + [(399 - i, [1.0, *rng.integers(1, 1000, 7).tolist()]) for i in range(400)]
    rows = [(i, [float(c) for c in v]) for i, v in rows]
    got = collected(nearest(frame(spark, rows), F.col("vec_id") == 1000, shard=50, trees=6))
    assert got == {1000: [(i, 1.0) for i in range(20)]}
