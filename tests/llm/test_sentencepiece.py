import random

import pytest
from public_tokenizers import path as tokenizer_path
from sentencepiece import SentencePieceProcessor

from gridtide.llm import sentencepiece as m

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return m.Pieces.load(PATH)


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(1)
    letters = list("abcdeést  \n\t.,'0123") + ["the ", "ing", "tion", " ", "  ", "日", "😀", "▁", "ment", "<0x0A>", "<s>"]
    made = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(250)]
    return [*made, "", " ", "   ", "x", "a" * 500, "antidisestablishment" * 30, "word " * 3000, "é" * 100, "日本語" * 40]


def test_pieces_of_texts_are_those_of_the_library(spark, pieces, library):
    every = texts()
    rows = [(i, t, "clash", 1) for i, t in enumerate(every)] + [(0, every[0], "clash", 1), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, key int")
    out = m.decode(m.encode(docs, pieces), pieces)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == library.encode(r.text or ""), repr(r.text)
        assert r.decoded == (r.text or "").replace("▁", " ")


@pytest.mark.parametrize("long", [0, 10_000])
def test_both_merge_folds_agree(spark, pieces, library, monkeypatch, long):
    monkeypatch.setattr(m, "LONG", long)
    words = sorted({"▁" + w for t in texts()[:120] for w in t.split(" ") if w and "▁" not in w and len(w) < 60})
    got = dict(m.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect())
    assert set(got) == set(words)
    for w in words:
        assert got[w] == library.encode(w[1:]), w


def unigram():
    pieces = [("<unk>", 0.0, "unknown")] + [(c, -8.0 - i, "normal") for i, c in enumerate("▁abcd")]
    pieces += [("ab", -6.0, "normal"), ("abc", -9.5, "normal"), ("bcd", -7.0, "normal"), ("▁a", -5.0, "normal"), ("cd", -6.5, "normal")]
    return m.Pieces([(i, p, s, k) for i, (p, s, k) in enumerate(pieces)], False, True, 0)


def every_path(word, scores):
    if not word:
        return [(0.0, [])]
    out = []
    for n in range(1, len(word) + 1):
        if word[:n] in scores:
            out += [(scores[word[:n]][1] + s, [scores[word[:n]][0], *ids]) for s, ids in every_path(word[n:], scores)]
    return out


@pytest.mark.parametrize("long", [0, 10_000])
def test_viterbi_finds_the_best_of_all_paths(spark, monkeypatch, long):
    monkeypatch.setattr(m, "LONG", long)
    pieces = unigram()
    scores = {p: (i, s) for i, p, s, k in pieces.rows if k == "normal"}
    rng = random.Random(2)
    words = sorted({"▁" + "".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(120)})
    got = dict(m.encode_words(spark.createDataFrame([(w,) for w in [*words, "▁xaby"]], "word string"), pieces).collect())
    value = {i: s for i, s in scores.values()}
    for w in words:
        best = max(s for s, _ in every_path(w, scores))
        assert sum(value[i] for i in got[w]) == pytest.approx(best)
    names = {i: p for i, p, *_ in pieces.rows}
    assert [names[i] for i in got["▁xaby"]] == ["▁", "<unk>", "ab", "<unk>"]


def test_empty_table_and_null_ids(spark, pieces):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert m.encode(docs, pieces).collect() == []
    none = spark.createDataFrame([(None,), ([10**6, 1],)], "ids array<int>")
    assert sorted((r.decoded for r in m.decode(none, pieces).collect()), key=repr) == ["", None]
