"""The stages of the pipeline against brute force, on the smallest tables."""

import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as m
from gridtide.llm.pii import pseudonymise
from gridtide.llm.toxicity import scored, train
from gridtide.session import materialize
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = [docs]
    for name, stage in m.STAGES:
        docs = materialize(stage(spark, docs, SF_DIR), name)
        seen.append(docs)
    return seen


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxic_documents_go(spark, stages):
    model = train(stages[0], spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    want = {r.doc_id for r in scored(stages[0], model).collect() if r.score < 0.5}
    assert set(by_id(stages[1])) == want


def test_copies_go(stages):
    least = {}
    for i, r in by_id(stages[1]).items():
        key = re.sub("[\x20\x09-\x0d]+", " ", r.text or "")
        least[key] = min(i, least.get(key, i))
    assert set(by_id(stages[2])) == set(least.values())


def test_near_copies_go(stages):
    rows = sorted(by_id(stages[2]).values(), key=lambda r: r.doc_id)
    ids = [r.doc_id for r in rows]
    assert set(by_id(stages[3])) == set(plain_components(ids, [plain_fingerprint(r.text) for r in rows]))


def test_private_values_are_replaced(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    want = by_id(pseudonymise(stages[3], m.KEY))
    assert set(before) == set(after)
    for i, r in after.items():
        assert r.text == want[i].text and r.n_chars == len(r.text)
        assert not re.search(r"[a-z0-9]+@[a-z0-9]+\.example", r.text)


def test_every_token_is_packed(stages):
    library = Tokenizer.from_file(m.TOKENIZER)
    length = {i: len(library.encode(r.text, add_special_tokens=False).ids) for i, r in by_id(stages[4]).items()}
    got = {}
    for r in stages[5].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == length


def test_run_gives_the_same(spark, stages):
    key = lambda r: (r.doc_id, r.piece)
    assert sorted(map(key, m.run(spark, SF_DIR).collect())) == sorted(map(key, stages[5].collect()))


def test_empty_documents(spark, stages, tmp_path):
    docs = stages[0].limit(0)
    for _, stage in m.STAGES:
        docs = materialize(stage(spark, docs, SF_DIR), "empty")
    assert docs.count() == 0


def test_nulls_clashing_columns_and_no_labels(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, score int, fp long, id string, key int"
    texts = [(None, None), (None, "no id"), (1, None), (2, ""), (3, "one text"), (4, "one  text"), (5, "write to a@b.org " * 400)]
    rows = [(i, t, None, None, None if t is None else len(t), "r", 7, 8, "i", 9) for i, t in texts]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in m.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == [c.split(" ")[0] for c in schema.split(", ")]
    kept = docs.collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 1, 3, 5]
    assert all((r.row, r.score, r.fp, r.id, r.key) == ("r", 7, 8, "i", 9) for r in kept)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept)
    packed = m.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {None, 1, 3, 5}
    assert [r.bin_id for r in packed if r.doc_id == 1] == [None]
