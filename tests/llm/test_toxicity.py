import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.llm import toxicity as m

BAD = ["gronk", "slarpid", "vumble", "drekhead"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "tan", "re", "shu", "ve", "on"]
    vocabulary = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(30, 200))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(4, 9)):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t, "score") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return rows, docs, labels, m.train(docs, labels, per_class=200, calibration=800)


def test_held_out_rows_are_told_apart(spark, model):
    rows, docs, _, fitted = model
    out = {r.doc_id: r.score for r in m.scored(docs, fitted).collect()}
    held = [(out[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 200
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.97
    flags = {r.id: r.h for r in docs.select(F.col("doc_id").alias("id"), m.held_out(F.col("doc_id")).alias("h")).collect()}
    assert flags == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}


def test_one_bad_passage_in_a_long_text(spark, model):
    rows, _, _, fitted = model
    clean = " ".join(t for _, t, y in rows[:400] if not y)
    bad = clean[: len(clean) // 2] + (" " + " ".join(BAD)) * 12 + clean[len(clean) // 2 :]
    docs = spark.createDataFrame([(1, clean), (2, bad), (3, None), (4, ""), (5, " \n"), (5, " \n")], "doc_id long, text string")
    s = sorted((r.doc_id, r.score) for r in m.scored(docs, fitted).collect())
    assert s[1][1] > s[0][1] and s[2][1] == s[3][1] == s[4][1] == s[5][1] < 0.5
    assert all(0 <= x <= 1 for _, x in s)


def test_labels_of_one_class_or_none(spark, model):
    _, docs, labels, _ = model
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        constant = m.train(docs, some)
        scores = {r.score for r in m.scored(docs.limit(20), constant).collect()}
        assert len(scores) == 1 and max(scores) <= 0.5
    few = labels.where("doc_id < 12")
    assert m.scored(docs.limit(20), m.train(docs, few)).count() == 20


def test_rejected_documents_go(spark, model):
    rows, docs, labels, _ = model
    kept = m.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert sum(y for i, _, y in rows if i in ids) < 30 and len(ids) > 1150
    assert m.drop_toxic(docs.limit(0), labels).collect() == []


def test_whole_text_counts():
    d = m.Dictionaries.train([b"gronk a", b"gronk b"], [b"quiet words", b"other words"])
    counter = d.differences()
    words = b"quiet other words " * 50
    assert counter.features(words)[0] == pytest.approx(np.log(50))
    assert counter.features(None)[0] == 0


def test_training_reads_whole_texts(spark, monkeypatch):
    rows = [(i, "calm words of no harm " * 900 + t) for i, t, _ in corpus(200)]  # what tells lies past 20,000 characters
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus(200)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(m.Dictionaries, "train", classmethod(lambda cls, bad, good, **_: seen.extend([bad, good]) or cls(b"a" * 9, b"b" * 9)))
    fitted = m.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert all(any(w.encode() in t for w in BAD) for t in seen[0]) and seen[1]
    assert fitted.mean[0] > np.log(900 * 5 / 3)


def test_ordinary_lines_come_from_all_parts_and_long_texts_are_thinned_evenly():
    text = [b"w%d" % i for i in range(5000)]
    assert sorted(w for line in m._lines([text]) for w in line.split()) == sorted(text)
    assert 5_000 < sum(map(len, m._lines([text], 10_000))) <= 10_000
    places = [int(w[1:]) for w in m.thinned(b" ".join(text), 10_000).split()]
    assert places == sorted(places) and places[0] < 1000 and places[-1] > 4000
    assert m.thinned(b"a b", 3) == b"a b"
    assert m._bound([1, 10, 100], 200) == 100 and m._bound([1, 10, 100], 31) == 20


def test_windows_of_two_words_and_a_bounded_memory_of_them(model, monkeypatch):
    assert model[3].dictionaries.differences().features(b"a b c d")[0] == np.log(2)
    texts = [t.encode() for _, t, _ in corpus(60)]
    dictionaries = m.Dictionaries.train(texts[::5], texts[1::5], window=2)
    kept = dictionaries.differences()
    want = [kept.features(t) for t in texts]
    assert kept.features(b"a b c d")[0] == np.log(2)
    monkeypatch.setattr(m, "CACHE", 10)
    few = dictionaries.differences()
    assert all((few.features(t) == w).all() for t, w in zip(texts, want)) and len(few.known) <= 10


def test_texts_together_give_what_each_gives_alone(monkeypatch):
    """Also where a text ends within a window, keys share a place and words start anew."""
    texts = [t.encode() for _, t, _ in corpus(40)] + [b"", None, b"gronk", b"a b c d e f g"]
    for window in (1, 2, 3, 4):
        dictionaries = m.Dictionaries.train(texts[0:40:5], texts[1:40:5], window=window)
        plain = [len(x) for x in map(m.words_of, (t or b"" for t in texts))]
        alone = [dictionaries.differences().features(t) for t in texts]
        assert [round(np.exp(x[0])) for x in alone] == [max(-(-n // window), 1) for n in plain]
        one, other = m._compressor(dictionaries.ordinary), m._compressor(dictionaries.toxic)
        words = m.words_of(texts[0])
        framed = [b"%b %b " % (m.ANCHOR, b" ".join(words[i : i + window])) for i in range(0, len(words), window)]
        saved = [len(one.compress(x)) - len(other.compress(x)) for x in framed]
        assert alone[0][1] == sum(saved) / len(saved)
        for cache, numbered, chunk in ((1 << 16, 1 << 18, 4096), (7, 1 << 18, 50), (1 << 10, 30, 16)):
            monkeypatch.setattr(m, "CACHE", cache)
            monkeypatch.setattr(m, "WORDS", numbered)
            monkeypatch.setattr(m, "CHUNK", chunk)
            counter = dictionaries.differences()
            for _ in range(2):
                together = list(counter.features_of(texts))
                assert len(together) == len(texts) and all((a == b).all() for a, b in zip(together, alone))


def test_windows_come_to_the_compressor_many_at_a_time(model):
    counter, calls = model[3].dictionaries.differences(), []
    real = counter.ordinary
    counter.ordinary = lambda framed: calls.append(len(framed)) or real(framed)
    assert len(list(counter.features_of(t.encode() for _, t, _ in model[0][:200]))) == 200
    assert len(calls) <= 4 and sum(calls) > 1000
