import itertools
import random

import pytest
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridtide.llm import packing as m
from gridtide.llm.queries import op6_packing
from gridtide.llm.token_counts import token_counter

SF_DIR = "/root/testdata/sf0.001"


def valid(lengths, at, offset, final, sizes):
    held = {}
    for n, k, o in zip(lengths, at, offset):
        held.setdefault(k, []).append((o, n))
    assert sorted(held) == list(range(len(final)))
    for k, pieces in held.items():
        end = 0
        for o, n in sorted(pieces):
            assert o == end
            end += n
        assert end <= final[k] and final[k] == min(s for s in sizes if s >= end)


def least_cost(lengths, sizes, costs):
    """Brute force: every assignment of pieces to sequences."""
    best = None
    for groups in itertools.product(range(len(lengths)), repeat=len(lengths)):
        sums = {}
        for g, n in zip(groups, lengths):
            sums[g] = sums.get(g, 0) + n
        if max(sums.values()) > sizes[-1]:
            continue
        cost = sum(costs[min(s for s in sizes if s >= x)] for x in sums.values())
        best = cost if best is None else min(best, cost)
    return best


def test_small_cases_stay_near_the_least_cost():
    rng = random.Random(1)
    sizes = [8, 16, 32]
    costs = m.usual_costs(sizes)
    ratios = []
    for _ in range(40):
        lengths = [rng.randint(1, 32) for _ in range(rng.randint(1, 6))]
        at, offset, final = m.pack(lengths, sizes, costs)
        valid(lengths, at, offset, final, sizes)
        ratios.append(sum(costs[s] for s in final) / least_cost(lengths, sizes, costs))
    assert min(ratios) >= 1 and sum(ratios) / len(ratios) < 1.02 and max(ratios) < 1.3


def test_joint_choice_is_no_dearer_than_any_single_length():
    rng = random.Random(2)
    costs = {512: 700.0, 1024: 1100.0, 2048: 2600.0}
    lengths = [rng.choice([60, 300, 500, 900, 1500]) for _ in range(800)]
    _, _, joint = m.pack(lengths, list(costs), costs)
    _, _, single = m.pack(lengths, [2048], {2048: costs[2048]})
    assert sum(costs[s] for s in joint) <= sum(costs[s] for s in single)
    assert sum(lengths) / sum(joint) > 0.95


@pytest.mark.parametrize("block", [7, 50_000])
def test_every_token_is_packed_once(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK", block)
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 5, 300, 700, 2048, 2049, 10_000]), "x") for i in range(300)]
    rows += [(300, 0, "x"), (301, None, "x"), (302, -4, "x"), (None, 12, "x"), (5, 8, "x"), (5, 8, "x"), (303, 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, n long, bin_id string").repartition(3)
    out = m.packed(docs, F.col("n"), sizes=(512, 2048)).toPandas()
    assert sorted(out.groupby("doc_id", dropna=False).length.sum().fillna(0).tolist()) == sorted(
        {i: sum(max(r[1] or 0, 0) for r in rows if r[0] == i) for i, *_ in rows}.values()
    )
    assert out[out.length == 0].bin_id.isna().all() and len(out[out.length == 0]) == 3
    full = out[out.length > 0]
    for _, one in full.groupby("bin_id"):
        spans = sorted(zip(one.bin_start, one.length))
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
        assert sum(n for _, n in spans) <= one.bin_size.iloc[0] and one.bin_size.nunique() == 1
    long = full[full.doc_id == 303].sort_values("piece")
    assert long.start.tolist() == list(range(0, 50_000, 2048)) and (long.piece == range(len(long))).all()
    report = m.fill_report(m.packed(docs, F.col("n"), sizes=(512, 2048))).collect()
    assert all(0 < r.filled <= 1 for r in report)


def test_pieces_are_spans_of_token_ids(spark):
    """The query's spans, filled with the library's ids, hold every document's ids once."""
    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    out = op6_packing(spark, SF_DIR).toPandas()
    for i, own in out.groupby("doc_id"):
        spans = [ids[i][a : a + n] for a, n in sorted(zip(own.start, own.length))]
        assert [x for s in spans for x in s] == ids[i]
    full = out[out.length > 0]
    assert (full.groupby("bin_id").length.sum() <= full.groupby("bin_id").bin_size.first()).all()
    assert set(out.doc_id) == set(ids)


def test_words_and_empty_table(spark):
    texts = ["", None, " ", "one", "a b c\td", "w " * 40_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r.n for r in docs.select(m.words(F.col("text")).alias("n")).collect()] == [0, None, 0, 1, 3, 40_000]
    assert m.packed(docs.limit(0), m.words(F.col("text"))).collect() == []


def test_tokens_are_counted_where_they_are_packed(spark):
    """One Python worker a task: the plan holds no second Python operator for the count."""
    path = tokenizer_path("byte_bpe_50k.json")
    out = op6_packing(spark, SF_DIR)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and plan.count("MapInArrow") == 1  # one_worker
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    apart = m.packed(docs, token_counter(spark, path)(F.col("text")))
    assert out.collect() == apart.collect() != []
