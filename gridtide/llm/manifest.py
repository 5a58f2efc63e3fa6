"""Merkle manifest of a dataset: digests of rows, of groups of rows and of the whole.

A leaf is the digest of a row's fields.  The leaves of a group stand in the order of their
ids; every ``ARITY`` consecutive nodes have the digest of their digests as parent, until
one is left, and the groups' last ones (in order of the groups) are the leaves of the tree
above.  Every node is labelled with the interval [lo, hi) of the leaf ranks it covers.  So
nothing has to say who is whose parent: an ancestor's interval contains the node's, and a
node's siblings are what its parent's interval has beside its own.

How it scales: levels go in bands of ``LEVELS``; a bucket of a band is the aligned interval
of 243 nodes under one node of the band's top, so one hot group is spread over many.
Bands are built upwards (each reads a 243rd of the one below) and proofs go downwards:
nodes meet the inner nodes of their bucket and what is known above it by an equi join on
the bucket, and containment picks the ancestors.  No task holds more than a bucket.  Texts
are read once and never moved; ranks come from a range sort of narrow rows.

Defined cases: NULL fields are ``-``; ids go upwards, NULL first, ties by leaf digest, so
repeated rows are leaves each; a group of one row is its own leaf; a NULL group comes
first; an empty table gives empty results and no root; columns that are not named as
fields are not read, and their names may be those of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.llm.ranks import ranked
from gridtide.session import materialize

ARITY = 3
LEVELS = 5  # of a band; a bucket has ARITY**LEVELS nodes
ABOVE = 64  # levels of the tree of groups count on from here; no group has as many

INNER = "tree bigint, n bigint, level int, lo bigint, hi bigint, digest string"
STEP = "tree bigint, block bigint, level int, lo bigint, hi bigint, left string, right string"


def digest_of(fields: Iterable[Column]) -> Column:
    """Digest of the fields, each with its length in bytes before it."""
    def said(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[said(c) for c in fields]).cast("binary"), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def grow(level: int, n: int, nodes: list[tuple[int, int, str]], levels: int = LEVELS) -> list[tuple[int, int, int, str]]:
    """The nodes (level, lo, hi, digest) above the (lo, hi, digest) of one bucket: a band
    of levels, or up to the last node where the bucket is all of a tree of ``n`` leaves."""
    out, whole = [], nodes[0][0] == 0 and nodes[-1][1] == n
    for step in range(1, levels + 1):
        if whole and len(nodes) == 1:
            break
        runs = [nodes[i : i + ARITY] for i in range(0, len(nodes), ARITY)]
        nodes = [(r[0][0], r[-1][1], _hash("".join(d for _, _, d in r))) for r in runs]
        out += [(level + step, *x) for x in nodes]
    return out


def steps(
    level: int, base: list[tuple[int, int, str]], inner: list[tuple[int, int, int, str]], above: list[tuple], levels: int = LEVELS
) -> list[list[tuple[int, int, int, str, str]]]:
    """For each base node of a bucket, level by level to the root: (level, lo, hi) of the
    ancestor that contains it and the digests of the siblings before and behind it."""
    at = {(level, lo): (lo, hi, d) for lo, hi, d in base}
    at |= {(k, lo): (lo, hi, d) for k, lo, hi, d in inner}
    wide = {k: ARITY**k for k in range(level, level + levels + 1)}
    beside: dict[tuple[int, int], tuple[int, int, int, str, str]] = {}
    for k, lo, hi, _ in inner:
        # The parent's interval less the child's, in nodes of the child's level.
        children = [at[k - 1, x] for x in range(lo, hi, wide[k - 1])]
        for own, _, _ in children:
            before = "".join(d for _, b, d in children if b <= own)
            behind = "".join(d for a, _, d in children if a > own)
            beside[k - 1, own] = (k, lo, hi, before, behind)
    out = []
    for lo, _, _ in base:
        own, k = [], level
        while (k, start := lo // wide[k] * wide[k]) in beside:
            own.append(beside[k, start])
            k += 1
        out.append(own + above)
    return out


def _wide(band: int, levels: int) -> int:
    """Leaves under a node at the foot of a band, where there are as many."""
    return ARITY ** (band * levels)


def _bucket(band: int, levels: int) -> Column:
    return F.expr(f"lo div {_wide(band + 1, levels)}").alias("block")


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    named = [c.split() for c in schema.split(", ")]
    return pa.table({c: pa.array([r[i] for r in rows], kinds[k]) for i, (c, k) in enumerate(named)})


def _growing(level: int, levels: int):
    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("lo", "hi", "digest"))))
        tree, n = table.column("tree")[0].as_py(), table.column("n")[0].as_py()
        return _table([(tree, n, *x) for x in grow(level, n, rows, levels)], INNER)

    return build


def _bands(leaves: DataFrame, largest: int, levels: int) -> list[tuple[DataFrame, DataFrame]]:
    """Per band its base nodes and the inner nodes over them, from the leaves (tree, n, lo,
    hi, digest) of trees of at most ``largest`` leaves."""
    out, base, band = [], leaves, 0
    while True:
        keyed = base.select("tree", "n", "lo", "hi", "digest", _bucket(band, levels))
        inner = materialize(keyed.groupBy("tree", "block").applyInArrow(_growing(band * levels, levels), INNER), "nodes")
        out.append((base, inner))
        band += 1
        if _wide(band, levels) >= largest:
            return out
        base = inner.where((F.col("level") == band * levels) & (F.col("n") > _wide(band, levels))).drop("level")


def _known(inner: DataFrame, band: int, above: DataFrame, levels: int) -> DataFrame:
    """What a bucket's base nodes are joined with: its inner nodes, and the steps above it."""
    nothing = F.lit(None).cast("string")
    nodes = inner.select("tree", _bucket(band, levels), "level", "lo", "hi", "digest", nothing.alias("left"), nothing.alias("right"))
    return nodes.unionByName(above.withColumn("digest", nothing))


def _inside(band: int, base: pa.Table, known: pa.Table, levels: int) -> tuple[list, list]:
    rows = sorted(zip(*(base.column(c).to_pylist() for c in ("lo", "hi", "digest"))))
    inner, above = [], []
    for k, lo, hi, d, a, b in zip(*(known.column(c).to_pylist() for c in ("level", "lo", "hi", "digest", "left", "right"))):
        if d is None:
            above.append((k, lo, hi, a, b))
        else:
            inner.append((k, lo, hi, d))
    return rows, steps(band * levels, rows, inner, sorted(above), levels)


def _descending(band: int, levels: int):
    """The steps above each base node of a bucket; the node is a bucket of the band below."""

    def down(key: tuple, base: pa.Table, known: pa.Table) -> pa.Table:
        rows, paths = _inside(band, base, known, levels)
        return _table([(key[0].as_py(), lo // _wide(band, levels), *s) for (lo, _, _), path in zip(rows, paths) for s in path], STEP)

    return down


def _met(base: DataFrame, known: DataFrame, band: int, levels: int, *more: str):
    keyed = base.select("tree", "lo", "hi", "digest", *more, _bucket(band, levels))
    return keyed.groupBy("tree", "block").cogroup(known.groupBy("tree", "block"))


def _descend(bands: list[tuple[DataFrame, DataFrame]], over_roots: DataFrame, levels: int) -> DataFrame:
    """Steps above the buckets of the lowest band; ``over_roots``: those above each tree's
    root (block 0)."""
    above = None
    for band in range(len(bands) - 1, 0, -1):
        base, inner = bands[band]
        known = _known(inner, band, _over(over_roots, base, band, above, levels), levels)
        above = materialize(_met(base, known, band, levels).applyInArrow(_descending(band, levels), STEP), "steps")
    return _over(over_roots, bands[0][0], 0, above, levels)


def _over(over_roots: DataFrame, base: DataFrame, band: int, above: DataFrame | None, levels: int) -> DataFrame:
    """Steps above the buckets of a band: of trees that end in it those above the root."""
    here = base.where(F.col("n") <= _wide(band + 1, levels)).select("tree").distinct()
    ending = over_roots.join(here, "tree", "left_semi")
    return ending if above is None else ending.unionByName(above)


def _roots(leaves: DataFrame, bands: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(tree, digest) of the node that covers all of a tree."""
    found = leaves.where("n = 1").select("tree", "digest")
    for _, inner in bands:
        found = found.unionByName(inner.where("lo = 0 and hi = n").select("tree", "digest"))
    return found


class Manifest:
    """The manifest of a table.  ``root``: its digest, None for an empty table;
    ``groups``: (tree, group, n, subroot); ``leaves``: (tree, n, lo, hi, digest, id, seen)."""

    def __init__(
        self, docs: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "source", seen: Column | None = None,
        levels: int = LEVELS,
    ):
        """``leaf``: digest of a row; ``seen``: that of the same row as it is to be checked
        (of a copy, say), where it may differ."""
        self.levels = levels
        own = docs.select(
            F.col(f"`{group_col}`").alias("group"), F.col(f"`{id_col}`").alias("id"), leaf.alias("digest"),
            (leaf if seen is None else seen).alias("seen"),
        )
        rows = materialize(own, "leaves")
        counts = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
        trees = materialize(ranked(counts, [F.col("group").asc_nulls_first()], name="tree"), "groups")
        size = trees.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("largest")).first()
        named = rows.alias("l").join(trees.alias("t"), F.col("l.group").eqNullSafe(F.col("t.group")))
        order = [F.col("tree"), F.col("id").asc_nulls_first(), F.col("digest")]
        placed = ranked(named.select("tree", "n", "id", "digest", "seen"), order, "tree", "lo")
        self.leaves = materialize(placed.withColumn("hi", F.col("lo") + 1), "placed")
        self.bands = _bands(self.leaves, size["largest"] or 0, levels)
        subroots = materialize(_roots(self.leaves, self.bands), "subroots")
        self.groups = trees.join(subroots.withColumnRenamed("digest", "subroot"), "tree")
        tops = subroots.select(
            F.lit(0).cast("bigint").alias("tree"), F.lit(size["groups"]).cast("bigint").alias("n"),
            F.col("tree").alias("lo"), (F.col("tree") + 1).alias("hi"), "digest",
        )
        self.top_leaves = tops
        self.top_bands = _bands(tops, size["groups"], levels)
        root = _roots(tops, self.top_bands).first()
        self.root: str | None = root["digest"] if root else None

    def nodes(self) -> DataFrame:
        """All nodes: (tree, level, lo, hi, digest).  The tree of groups is tree NULL."""
        cols = ["tree", "level", "lo", "hi", "digest"]
        out = self.leaves.withColumn("level", F.lit(0)).select(*cols)
        for _, inner in self.bands:
            out = out.unionByName(inner.select(*cols))
        top = self.top_leaves.withColumn("level", F.lit(0)).select(*cols)
        for _, inner in self.top_bands:
            top = top.unionByName(inner.select(*cols))
        return out.unionByName(top.withColumn("tree", F.lit(None).cast("bigint")))

    def _above(self) -> DataFrame:
        """Steps above the buckets of each group's leaves."""
        nothing = self.top_leaves.sparkSession.createDataFrame([], STEP)
        over, (base, inner) = _descend(self.top_bands, nothing, self.levels), self.top_bands[0]

        # A leaf of the tree of groups is the root of a tree, which is its block 0.
        of_groups = _met(base, _known(inner, 0, over, self.levels), 0, self.levels).applyInArrow(_descending(0, self.levels), STEP)
        groups = materialize(
            of_groups.select(F.col("block").alias("tree"), F.lit(0).cast("bigint").alias("block"),
                             (F.col("level") + ABOVE).alias("level"), "lo", "hi", "left", "right"),
            "steps",
        )
        return _descend(self.bands, groups, self.levels)

    def proofs(self, siblings: bool = False) -> DataFrame:
        """Per leaf: tree, id, leaf, proof (digest of its siblings, level by level to the
        root, left to right) and folded, the root that ``seen`` and the siblings give;
        ``siblings`` adds them, as an array of (level, lo, hi, left, right)."""
        id_type = self.leaves.schema["id"].dataType.simpleString()
        out = f"tree bigint, id {id_type}, leaf string, proof string, folded string"
        path_type = pa.list_(pa.struct([("level", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("left", pa.string()), ("right", pa.string())]))
        levels = self.levels
        if siblings:
            out += ", siblings array<struct<level int, lo bigint, hi bigint, left string, right string>>"

        def prove(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.sort_by("lo")
            rows, paths = _inside(0, left, right, levels)
            roots: dict[tuple[int, str], str] = {}  # what a digest at a level above the bucket becomes
            proofs, folded = [], []
            for seen, path in zip(left.column("seen").to_pylist(), paths):
                proofs.append(_hash("".join(a + b for *_, a, b in path)))
                own, met = seen, []
                for level, _, _, before, behind in path:
                    if level > levels:
                        if (level, own) in roots:
                            own = roots[level, own]
                            break
                        met.append((level, own))
                    own = _hash(before + own + behind)
                roots |= dict.fromkeys(met, own)
                folded.append(own)
            got = {"tree": left.column("tree"), "id": left.column("id"), "leaf": left.column("digest"),
                   "proof": pa.array(proofs, pa.string()), "folded": pa.array(folded, pa.string())}
            if siblings:
                named = [[dict(zip(("level", "lo", "hi", "left", "right"), s)) for s in path] for path in paths]
                got["siblings"] = pa.array(named, path_type)
            return pa.table(got)

        base, inner = self.bands[0]
        return _met(base, _known(inner, 0, self._above(), levels), 0, levels, "id", "seen").applyInArrow(prove, out)


def verified(manifest: Manifest, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256, folded_root and verified."""
    proofs = manifest.proofs().join(manifest.groups.select("tree", "subroot"), "tree")
    root = F.lit(manifest.root).cast("string")
    return proofs.select(
        F.col("id").alias(id_col), "leaf", "subroot", root.alias("root"), F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"),
    )
