import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gridtide.llm import bitmaps, exact_dedup
from gridtide.llm.exact_dedup import drop_copies, exact_duplicates
from gridtide.session import materialize

SCHEMA = "doc_id long, text string, keep_id string, row int, page long, hit int"


def rows():
    rng = random.Random(1)
    out, n = [], 0
    for _ in range(40):
        base = " ".join(rng.choices(["ab", "cd", "Ä", "ef gh"], k=rng.randint(0, 5)))
        for _ in range(rng.randint(1, 4)):
            out.append((n, base.replace(" ", rng.choice([" ", "\n\t", "  "]))))
            n += 1
    long = "x y " * 30_000
    out += [(n, long + "a"), (n + 1, long + "b"), (n + 2, long + "a"), (n + 3, ""), (n + 4, None), (n + 5, " "), (n + 6, "\x1c")]
    out += [(n + 7 + k, "copy of many") for k in range(200)]
    out += [(None, "copy of many"), (None, "nameless"), (None, "nameless"), (3, out[3][1])]
    rng.shuffle(out)
    return [(i, t, "clash", 1, 2, 3) for i, t in out]


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


@pytest.mark.parametrize("every", [False, True])
def test_against_a_dictionary(spark, every):
    data = rows()
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t, *_ in data:
        known = [x for x in groups[norm(t)] if x is not None]
        keep = min(known) if known else None
        want.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    got = [
        (r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex() if r.digest else None)
        for r in exact_duplicates(spark.createDataFrame(data, SCHEMA), prefix=8, digest_all=every).collect()
    ]
    if not every:
        digests = {w[4] for w in want if w[2] > 1}
        assert digests <= {g[4] for g in got}
        want, got = [w[:4] for w in want], [g[:4] for g in got]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_kept_rows_come_back_unchanged(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    least = {}
    for i, t, *_ in data:
        if i is not None:
            least[norm(t)] = min(least.get(norm(t), i), i)
    want = [r for r in data if r[0] is None or least[norm(r[1])] == r[0]]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)


def test_bitmap_marks_every_key_and_few_others(spark):
    bits = bitmaps.size_for(5000)
    keys = spark.range(0, 5000).selectExpr("xxhash64(id) AS k")
    table = bitmaps.pages(keys, F.col("k"), bits)
    marked = bitmaps.marked(spark.range(0, 20_000), F.xxhash64("id"), table, bits, "hit")
    assert marked.where("id < 5000 and not hit").count() == 0
    assert marked.where("id >= 5000 and hit").count() < 2500


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(docs).collect() == []
    assert drop_copies(docs).collect() == []


def test_small_tables_and_coincidences_take_few_files(spark, tmp_path, monkeypatch):
    made = {}

    def noted(df, name="step", **more):
        made[name] = materialize(df, name, **more)
        return made[name]

    monkeypatch.setattr(exact_dedup, "materialize", noted)
    docs = spark.range(0, 6000, 1, 12).selectExpr("id AS doc_id", "concat('a fine text ', id % 4000) AS text")
    drop_copies(docs).write.parquet(f"{tmp_path}/kept")
    kept = spark.read.parquet(f"{tmp_path}/kept")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(4000))
    assert len(kept.inputFiles()) < 16  # 12 parts of the input, few more of coincidences
    assert {name: len(made[name].inputFiles()) for name in ("digests", "dropped")} == {"digests": 1, "dropped": 1}
