import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.llm.curriculum import cycled, in_order, measured, mix, sources_of, taken, with_targets
from gridtide.llm.ranks import ranked

SCHEMA = "doc_id long, source string, text string, size string, position double, place int"
MOVES = ((1.5, 0.5), (1, 1), (0.5, 1.5))


def frame(spark, rows):
    return spark.createDataFrame([(i, s, t, "clash", 0.5, 1) for i, s, t in rows], SCHEMA)


def corpus(seed=1, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["Ä", "b", "", None, "tiny"])
        rows.append((i, source, " ".join(["w"] * rng.choice([0, 1, 3, 8, 21, 55]))))
    rows += [(900, "tiny", None), (901, "mute", ""), (902, "mute", " \n"), (903, "one", "w " * 5_000), (904, "hot", "x\ty\x0bz z")]
    return rows + [(None, "hot", "w w w"), (None, "hot", "w w"), (5, "hot", "w " * 5), (5, "hot", "w " * 5)]


def size(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return sum(1 for w in (text or "").split(" ") if w)


def plain_targets(sizes, weights, most=3):
    """Reshare what is above the limit until nothing is."""
    capped = set()
    while True:
        free = [s for s in sizes if s not in capped and weights[s] > 0]
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        total = sum(weights[s] for s in free)
        target = {s: left * weights[s] / total for s in free}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return {s: target.get(s, most * sizes[s] if s in capped else 0.0) for s in sizes}
        capped |= over


def plain_mix(rows, weights):
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = plain_targets(sizes, weights)
    out = []
    for s in sizes:
        docs = sorted((hashlib.md5(f"{'' if i is None else i}:{size(t)}".encode()).hexdigest(), size(t), k) for k, (i, x, t) in enumerate(rows) if x == s)
        full = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, before, again = target[s] - full * sizes[s], 0, {}
        for key, n, k in docs:
            again[k] = before + n / 2 < rest and n > 0
            before += n
        gap = rest - sum(n for _, n, k in docs if again[k])
        helps = [(abs(abs(gap) - n), key, n, k) for key, n, k in docs if n and again[k] == (gap < 0) and abs(abs(gap) - n) < abs(gap)]
        if helps:
            again[min(helps)[3]] ^= True
        out += [(rows[k][0], n, sizes[s], target[s], n * (full + again[k]) if n else 0) for _, n, k in docs]
    return out


def weights_of(rows, weights=(5, 2, 1)):
    ordered = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    return {s: weights[k % len(weights)] for k, s in enumerate(ordered)}


@pytest.fixture(scope="module")
def mixed(spark):
    rows = measured(frame(spark, corpus()))
    return mix(rows, cycled(sources_of(rows), (5, 2, 1), MOVES))


def test_against_a_plain_mix(mixed):
    key = lambda r: (r[0] is None, r)
    got = sorted((tuple(r) for r in taken(mixed).collect()), key=lambda r: key(tuple(-1 if x is None else x for x in r)))
    want = sorted(plain_mix(corpus(), weights_of(corpus())), key=lambda r: key(tuple(-1 if x is None else x for x in r)))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])
    assert all(r[4] <= 3 * r[1] for r in got)


def test_positions_are_those_at_which_the_demand_is_due(mixed):
    """The integral of a source's schedule up to a copy's position is its share of words."""
    facts = {r.row: r for r in mixed.documents.collect()}
    rows = mixed.order.collect()
    ordered = sorted({r.source for r in facts.values()}, key=lambda s: (s is None, (s or "").encode()))
    words = {}
    for r in sorted(rows, key=lambda r: (r.position, r.copy)):
        fact = facts[r.row]
        start, end = MOVES[ordered.index(fact.source) % 3]
        due = start * r.position + (end - start) * r.position**2 / 2
        read = words.get(fact.source, 0)
        # Within a copy's own words and the document that mends the sum.
        assert abs(due * fact.target - min(read + r.size / 2, fact.target)) <= (5_000 if fact.source == "one" else 60)
        words[fact.source] = read + r.size
    assert all(0 <= r.position <= 1 for r in rows)


def test_order_is_sorted_by_position(mixed):
    at = mixed.order.withColumn("file", F.input_file_name()).collect()
    ranges = {}
    for r in at:
        ranges.setdefault(r.file, []).append(r.position)
    assert all(p == sorted(p) for p in ranges.values())
    bounds = sorted((min(p), max(p)) for p in ranges.values())
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))


def test_fading_source_stands_earlier(mixed):
    facts = {r.row: r.source for r in mixed.documents.collect()}
    by = {}
    for r in mixed.order.collect():
        by.setdefault(facts[r.row], []).append(r.position)
    ordered = sorted({s for s in facts.values()}, key=lambda s: (s is None, (s or "").encode()))
    hot = ordered.index("hot") % 3
    assert np.mean(by["hot"]) < 0.48 if hot == 0 else 0.55


def test_reruns_and_splits_agree(spark, mixed):
    data = corpus()
    random.Random(9).shuffle(data)
    rows = measured(frame(spark, data).repartition(5))
    again = mix(rows, cycled(sources_of(rows), (5, 2, 1), MOVES))
    assert sorted(map(repr, taken(again).collect())) == sorted(map(repr, taken(mixed).collect()))


def test_limits_are_reshared(spark):
    sources = spark.createDataFrame(
        [("a", 10, 1, 0, 100.0), ("b", 1000, 1, 1, 1.0), ("c", 40, 1, 2, 10.0), ("d", 0, 1, 3, 5.0), ("e", 500, 1, 4, 0.0)],
        "source string, source_size long, documents long, place long, w double",
    ).withColumn("knots", F.expr("array(named_struct('at', 0D, 'weight', w), named_struct('at', 1D, 'weight', w))"))
    got = {r.source: r.target for r in with_targets(sources).collect()}
    assert got == plain_targets({"a": 10, "b": 1000, "c": 40, "d": 0, "e": 500}, {"a": 100, "b": 1, "c": 10, "d": 5, "e": 0})
    assert got == {"a": 30, "b": 1400, "c": 120, "d": 0, "e": 0}


def test_schedules_of_several_pieces_and_none(spark):
    rows = measured(frame(spark, [(i, "late" if i % 2 else "even", "w " * 4) for i in range(200)] + [(999, "off", "w")]))
    late = "array(named_struct('at', 1D, 'weight', 4D), named_struct('at', 0D, 'weight', 0D), named_struct('at', 0.5D, 'weight', 0D))"
    even = "array(named_struct('at', 0D, 'weight', 1D), named_struct('at', 1D, 'weight', 1D))"
    got = mix(rows, sources_of(rows).withColumn("knots", F.expr(f"case source when 'late' then {late} when 'even' then {even} end")))
    rows = got.order.join(got.documents.select("row", "source"), "row").collect()
    assert min(r.position for r in rows if r.source == "late") > 0.5
    assert {r.source for r in rows} == {"late", "even"}
    n = sum(r.source == "late" for r in rows)
    assert np.isclose(sum(r.position < 0.75 for r in rows if r.source == "late") / n, 0.25, atol=0.02)


def test_texts_in_order(spark):
    docs = frame(spark, [(i, "s" if i % 3 else "t", "w " * (i % 7)) for i in range(60)])
    rows = measured(docs)
    mixed = mix(rows, cycled(sources_of(rows), (5, 1), MOVES))
    got = in_order(docs, mixed).collect()
    assert [r.position for r in got] == sorted(r.position for r in got)
    assert sum(size(r.text) for r in got) == sum(r.taken for r in taken(mixed).collect())


def test_empty_table_and_no_words(spark):
    for data in ([], [(1, "a", None), (2, None, "")]):
        rows = measured(frame(spark, data))
        got = mix(rows, cycled(sources_of(rows), (5, 2, 1), MOVES))
        assert got.order.count() == 0
        assert [r.taken for r in taken(got).collect()] == [0] * len(data)


def test_ranks_over_partitions(spark):
    data = [("g" if i % 3 else None, i * 7919 % 101) for i in range(300)]
    df = spark.createDataFrame(data, "k string, v int").repartition(7)
    got = ranked(df, [F.col("k"), F.col("v")], "k").collect()
    for k in ("g", None):
        own = sorted((r.rank, r.v) for r in got if r.k == k)
        assert [r for r, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
    whole = ranked(df, [F.col("v").desc()]).collect()
    assert sorted(r.rank for r in whole) == list(range(300))
    assert [r.v for r in sorted(whole, key=lambda r: r.rank)] == sorted((v for _, v in data), reverse=True)
