import random

import numpy as np
import pytest
import xxhash

from gridtide.llm import golay, simhash
from gridtide.llm.components import components
from gridtide.llm.simhash import drop_near_copies, fingerprint, keys_of, links, near_duplicates
from gridtide.session import materialize


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    fp = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    return fp - (1 << 64) if fp >> 63 else fp


def plain_components(ids, fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(fps)):
        r = root(i)
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(root(i)) for i in range(len(fps))]


def test_every_word_has_one_or_six_indices_and_neighbours_share_one():
    upper, errors = golay.tables()
    assert set((errors >= 0).sum(axis=1).tolist()) == {1, 6}
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    mine = golay.indices(words)
    for bit in range(23):
        other = golay.indices(words ^ (1 << bit))
        shared = ((mine[:, :, None] == other[:, None, :]) & (mine[:, :, None] >= 0)).any(axis=(1, 2))
        assert shared.all()


def test_fingerprints_within_two_bits_share_a_key():
    rng = np.random.default_rng(2)
    for _ in range(300):
        fp = int(rng.integers(-(1 << 63), 1 << 63))
        flips = rng.choice(64, rng.integers(0, 3), replace=False)
        other = fp
        for b in flips.tolist():
            other ^= -(1 << 63) if b == 63 else 1 << b
        a, _ = keys_of(np.array([fp]))
        b, _ = keys_of(np.array([other]))
        assert set(a.tolist()) & set(b.tolist())


@pytest.mark.parametrize("text", ["", None, " \n", "one", "One two", "a b c", "Ä b\x0bC d\x1ce É f", "x y z " * 9, "A b c d e f g h" * 20])
def test_fingerprint_by_hand(text):
    assert fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_long_text_is_counted_in_chunks(monkeypatch):
    import gridtide.llm.simhash as m

    text = " ".join(random.Random(3).choice("abcdefghij") * 3 for _ in range(500))
    whole = fingerprint(text.encode())
    monkeypatch.setattr(m, "CHUNK", 7)
    assert fingerprint(text.encode()) == whole == plain_fingerprint(text)


def test_components_of_paths_loops_and_nothing(spark):
    n = 60
    order = list(range(n))
    random.Random(4).shuffle(order)
    edges = list(zip(order, order[1:])) + [(1000, 1001), (1001, 1000), (2000, 2000)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000, 2000: 2000}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_links_of_crowded_and_sparse_groups(spark, monkeypatch):
    import gridtide.llm.simhash as m

    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64) - (1 << 63)
        chain = centre
        for _ in range(70):
            x = centre
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                x ^= -(1 << 63) if b == 63 else 1 << b
            fps.add(x)
        for b in rng.sample(range(63), 12):
            chain ^= 1 << b
            fps.add(chain)
    fps = sorted(fps)
    want = plain_components(fps, fps)
    for crowd in (2, 32, 10_000):
        monkeypatch.setattr(m, "CROWD", crowd)
        got = dict(components(links(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect())
        assert [got.get(x, x) for x in fps] == want


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    texts = []
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.randint(40, 400))
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n"]).join(copy))
    texts += ["", None, "  ", "One", "one", "x" * 200_000]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(None, texts[0], "n", 1), (None, "quite alone here", "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long")
    got = sorted(near_duplicates(docs).select("doc_id", "fp", "component_id").collect(), key=repr)
    fps = [plain_fingerprint(r[1]) for r in rows]
    named = plain_components([r[0] for r in rows], fps)
    assert got == sorted([(r[0], f, c) for r, f, c in zip(rows, fps, named)], key=repr)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for r, c in zip(rows, named) if r[0] is not None})


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).collect() == []
    assert drop_near_copies(docs).collect() == []


def test_small_tables_take_few_files(spark, monkeypatch):
    made = {}

    def noted(df, name="step", **more):
        made[name] = materialize(df, name, **more)
        return made[name]

    monkeypatch.setattr(simhash, "materialize", noted)
    docs = spark.range(0, 240, 1, 12).selectExpr("id AS doc_id", "concat_ws(' ', sha2(string(id % 200), 256), id % 200, 'end') AS text")
    kept = simhash.drop_near_copies(docs)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(200))
    small = ("fingerprints", "keys", "dropped")
    assert {name: len(made[name].inputFiles()) for name in small} == dict.fromkeys(small, 1)
