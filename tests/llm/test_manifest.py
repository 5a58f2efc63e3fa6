import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gridtide.llm import manifest as m

SCHEMA = "doc_id long, source string, text string, digest string, tree long, level int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(i, s, t):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, t)))


def climb(nodes):
    """All levels of a tree, from the leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def path(levels, k):
    out = []
    for level in levels[:-1]:
        first = k // 3 * 3
        out.append((level[first:k], level[k + 1 : first + 3]))
        k //= 3
    return out


def plain(rows, tamper):
    groups = {}
    for i, s, t in rows:
        groups.setdefault(s, []).append((i is not None, i or 0, leaf(i, s, t), (i, s, t)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s])]) for s in order}
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for k, (_, _, own, row) in enumerate(sorted(groups[s])):
            steps = path(trees[s], k) + path(top, g)
            proof = h("".join("".join(a) + "".join(b) for a, b in steps))
            folded = leaf(row[0], s, tamper(row[2])) if row[0] is not None and row[0] % 2 else own
            for a, b in steps:
                folded = h("".join(a) + folded + "".join(b))
            out.append((row[0], own, trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, s, t, "clash", 5, 6) for i, s, t in rows], SCHEMA)


def built(spark, rows, levels=5):
    docs = frame(spark, rows)
    whole = m.digest_of([F.col(c) for c in ("doc_id", "source", "text")])
    other = m.digest_of([F.col("doc_id"), F.col("source"), F.replace("text", F.lit("\n"), F.lit(""))])
    return m.Manifest(docs, whole, seen=F.when(F.col("doc_id") % 2 == 1, other).otherwise(whole), levels=levels)


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot"] * 5 + ["ä", "z", "", None]), rng.choice(["a\nb", "ab", "", None, "\n"])) for i in range(n)]
    rows += [(5000, "alone", "a\nb"), (None, "z", "nameless"), (None, "z", "nameless"), (7, "hot", "again\n"), (7, "hot", "again\n")]
    rows += [(5001 + k, "run", "x\n") for k in range(27)] + [(6001, "ä", "long \n" * 50_000)]
    rng.shuffle(rows)
    return rows


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_against_plain_trees(spark, levels):
    rows = corpus() if levels > 1 else corpus(90)
    got = m.verified(built(spark, rows, levels)).collect()
    assert ordered(got) == ordered(plain(rows, lambda t: t.replace("\n", "") if t else t))


@pytest.mark.parametrize("n", [1, 3, 10, 244])
def test_one_group_of_any_size(spark, n):
    rows = [(i, "s", f"{i}\n") for i in range(n)]
    got = m.verified(built(spark, rows)).collect()
    assert ordered(got) == ordered(plain(rows, lambda t: t.replace("\n", "")))


def test_nodes_cover_what_their_children_cover(spark):
    made = built(spark, corpus())
    nodes = {(r.tree, r.level, r.lo): r for r in made.nodes().collect()}
    assert len({(r.tree, r.level, r.lo) for r in nodes.values()}) == made.nodes().count()
    for (tree, level, lo), r in nodes.items():
        if level:
            children = sorted((c for (t, k, a), c in nodes.items() if t == tree and k == level - 1 and lo <= a < r.hi), key=lambda c: c.lo)
            assert 1 <= len(children) <= 3 and children[0].lo == lo and children[-1].hi == r.hi
            assert all(a.hi == b.lo for a, b in zip(children, children[1:]))
            assert h("".join(c.digest for c in children)) == r.digest


def test_siblings_fold_to_the_root(spark):
    made = built(spark, corpus(100))
    for r in made.proofs(siblings=True).collect():
        own = r.leaf
        for s in r.siblings:
            own = h(s.left + own + s.right)
        assert own == made.root


def test_order_of_rows_does_not_matter(spark):
    rows = corpus(150)
    assert built(spark, rows).root == built(spark, sorted(rows, key=repr)).root


def test_empty_table(spark):
    made = built(spark, [])
    assert made.root is None
    assert m.verified(made).collect() == [] and made.nodes().collect() == []
