import random

import pytest
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from gridtide.llm import token_counts as m

PATH = tokenizer_path("byte_bpe_50k.json")
ODD = [
    "", " ", "a  b", "\n\n x", "x\n \ny ", "it's DON'T we've I'll 'sx", "<|endoftext|> a<|endoftext|>", "日本語 text",
    "a b", "x\u0085y", "½ ² 3²", "tab\t\tx \t y", "É́a", "\x1cab \x1f c", "\x00\x01", "ʰa ǅ ª º", "…—“x”",
    "\r\n\r\nfoo  \r\n bar", " _ a_b", "x" * 3000, "12345 678,90", "👍🏽 ok", "  a 　b", "<|endoftext", "ſ 's",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        definition = f.read()
    return m.Counter(definition, m.whole_tokens(definition))


def want(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(counter, library, text):
    assert counter.count(text) == want(library, text)


def test_every_character_between_spaces_and_letters(counter, library):
    """Each code point next to letters, digits, single and double spaces."""
    wrong = []
    for c in map(chr, [*range(0x3100), *range(0xA000, 0xD800, 37), *range(0xF900, 0x20000, 53)]):
        text = f"a{c}b {c}  {c} 7{c}{c}"
        if counter.count(text) != want(library, text):
            wrong.append(hex(ord(c)))
    assert wrong == []


def test_words_with_high_characters_meet_the_proven_set(counter, library, monkeypatch):
    """A dash or a curly quote sends no other word past the shortcut."""
    merged = []
    real = counter.model
    monkeypatch.setattr(counter, "model", type("Model", (), {"tokenize": lambda self, p: merged.append(p) or real.tokenize(p)})())
    counter.known.clear()
    text = "the house — and “the” garden … of the people"
    assert counter.count(text) == want(library, text)
    assert not merged or all(not p.isascii() for p in merged)


def test_random_texts(counter, library):
    rng = random.Random(1)
    letters = list("aZé ß\n\t  '.,s1²_-<|>") + [" the", " of", "  ", "'s", "'ll", "\r\n", "<|endoftext|>", "ŋ", "ж", "\u2003", "\xa0", "—", "日本", "é", "’s"]
    for _ in range(4000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 30)))
        assert counter.count(text) == want(library, text), repr(text)


def test_cache_of_any_size_gives_the_same(counter, library, monkeypatch):
    monkeypatch.setattr(m, "CACHE", 3)
    text = "one two three four five six one two three " * 5
    assert counter.count(text) == want(library, text)


def test_proven_strings_are_one_token(counter, library):
    sample = random.Random(2).sample(sorted(counter.proven), 500)
    assert all(len(counter.model.tokenize(s.encode().decode("latin-1").translate(counter.letters))) == 1 for s in sample)


def test_operator(spark, library):
    rows = [(i, t, 5, 6) for i, t in enumerate([*ODD, None, "word " * 600])] + [(None, "a", 1, 1), (0, "", 1, 1), (0, "", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_bytes int")
    got = sorted(map(tuple, m.token_counts(docs, PATH).collect()), key=repr)
    expected = [(i, len((t or "").encode()), want(library, t or ""), want(library, t or "") > 512) for i, t, *_ in rows]
    assert got == sorted(expected, key=repr)
    assert m.token_counts(docs.limit(0), PATH).collect() == []
