"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree gives each vector a string of ``BITS`` bits, the sides of random hyperplanes
(orthonormal within a tree).  A tree is a sorted array of these strings.  A query descends
by binary search to its longest matching prefixes; then all trees ascend together, one bit
at a time, until the prefixes of that length hold ``share`` of the entries of all trees, and
``candidates`` at least.  So the prefix length at which a neighbour is met does not depend
on the number of vectors, and recall does not fall as the table grows.
Those candidates are compared with the query exactly, and the best of all trees are
merged.

Nearness is the inner product.  So that sides of hyperplanes order by it, each vector gets
one more component that brings it to the largest norm; queries get zero there.

On Spark: equal vectors are indexed once, with the smallest ids that can ever be wanted.
Trees are cut into shards by their first bits, as many as the number of vectors asks for
(``SHARD`` each), and a shard that is still larger (many vectors alike) is split by a hash;
its queries go to every part.  So no task holds more than about ``SHARD`` vectors; the work
of a query grows with the table, as its share does.  Two passes over the shards: the first
only counts entries per prefix length, from strings alone, and fixes where the ascent ends.
Prefixes shorter than a shard's are counted from the sizes of the shards, and a query whose
ascent ends there goes to every shard below.

Defined cases: vectors that are NULL, empty, of another length than most, zero, or hold
NULL or non-finite components take no part, neither as query nor as candidate; ties in
score go to the smaller id; equal vectors are all returned; rows with a NULL id take no
part; repeated rows of one id and vector count once, and an id with several vectors is
several vectors; fewer candidates than wanted give fewer rows; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.session import materialize

TREES, BITS = 48, 32
SHARE = 0.01  # of the entries of all trees, at which the ascent ends
CANDIDATES = 24_000  # entries over all trees that it reaches at least
SHARD = 1 << 16
SEED = 7


def hyperplanes(dimensions: int, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """(trees * bits, dimensions); orthonormal within a tree, in groups of at most
    ``dimensions``."""
    rng, rows = np.random.default_rng(seed), []
    for _ in range(trees):
        left = bits
        while left > 0:
            q = np.linalg.qr(rng.normal(size=(dimensions, dimensions)))[0]
            rows.append(q[: min(left, dimensions)])
            left -= dimensions
    return np.concatenate(rows)


def strings(vectors: np.ndarray, planes: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """(n, trees) bit strings as integers, the first bit the highest."""
    out = np.empty((len(vectors), trees), dtype=np.int64)
    weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
    for t in range(trees):
        out[:, t] = (vectors @ planes[t * bits : (t + 1) * bits].T > 0) @ weights
    return out


def prefix_ranges(sorted_strings: np.ndarray, string: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end position of the entries that share 0, 1, ..., ``bits`` bits."""
    shift = np.arange(bits, -1, -1, dtype=np.int64)
    low = (string >> shift) << shift
    return np.searchsorted(sorted_strings, low), np.searchsorted(sorted_strings, low + (np.int64(1) << shift))


def usable(vector: Column, dimensions: int) -> Column:
    """No NULL, no non-finite component, not zero, the right length."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (
        (F.size(vector) == dimensions) & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)
    )


def _matrix(column: pa.ChunkedArray | pa.Array, dimensions: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimensions)


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added from the first component to the last."""
    total = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        total += vectors[:, j] * query[j]
    return total


def foremost(rough: np.ndarray, n: int, slack: float) -> np.ndarray:
    """Positions of all values that may be among the n largest, each known up to ``slack``."""
    if len(rough) <= n:
        return np.arange(len(rough))
    return np.flatnonzero(rough >= np.partition(rough, len(rough) - n)[len(rough) - n] - 2 * slack)


def nearest(
    table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    trees: int = TREES, bits: int = BITS, candidates: int = CANDIDATES, shard: int = SHARD, seed: int = SEED,
    share: float = SHARE,
) -> DataFrame:
    """For each row with ``is_query`` (a condition on the columns of ``table``): query_id,
    rank (from 1), the id and the score of the ``k`` nearest other rows found."""
    spark = table.sparkSession
    raw = table.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), is_query.alias("q")
    ).where("id is not null and v is not null")
    sizes = raw.where("size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimensions = sizes["d"] if sizes else 1
    # -0.0 equals 0.0, so that equal vectors meet.
    rows = raw.where(usable(F.col("v"), dimensions)).select("id", F.transform("v", lambda x: x + 0.0).alias("v"), "q")

    # Equal vectors once, with their k + 1 smallest ids: no more can be wanted of them.
    same = Window.partitionBy("v").orderBy("id")
    ids = rows.select("id", "v").withColumn("n", F.dense_rank().over(same)).where(F.col("n") <= k + 1)
    vectors = materialize(
        ids.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("key"), F.xxhash64("v").alias("h"), "v", "ids"),
        "vectors",
    )
    asked = materialize(
        rows.where("q").select("id", F.xxhash64("v").alias("h"), "v").distinct(), "asked"
    )
    counted = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    top = counted["m"] or 0.0
    depth = min(bits, max(0, int(np.ceil(np.log2(max(counted["n"], 1) / shard)))))
    enough = max(candidates, int(np.ceil(share * trees * counted["n"])))
    planes = hyperplanes(dimensions + 1, trees, bits, seed)

    def hashed(as_query: bool):
        def run(batches):
            for b in batches:
                x = _matrix(b.column("v"), dimensions)
                lift = np.zeros(len(x)) if as_query else np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))
                s = strings(np.column_stack([x, lift]), planes, trees, bits)
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), b.column("h"), b.column("v"), pa.array(s.tolist(), pa.list_(pa.int64()))], ["key", "h", "v", "s"]
                )

        return run

    kept = "key bigint, h bigint, v array<double>, s array<bigint>"

    def in_trees(df: DataFrame, as_query: bool) -> DataFrame:
        each = df.mapInArrow(hashed(as_query), kept).select("key", "h", "v", F.posexplode("s").alias("tree", "s"))
        return each.withColumn("shard", F.shiftright("s", bits - depth) if depth else F.lit(0).cast("bigint"))

    # The queries: one row per distinct vector that a query has; key is its smallest id.
    distinct = asked.groupBy("v").agg(F.min("id").alias("key")).select("key", F.xxhash64("v").alias("h"), "v")
    entries, questions = in_trees(vectors, False), in_trees(distinct, True)
    parts = materialize(
        entries.groupBy("tree", "shard").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / shard)), "shards"
    )
    at = ["tree", "shard", "part"]
    placed = entries.join(parts.drop("n"), ["tree", "shard"]).withColumn("part", F.pmod("h", "parts"))

    def posed(to: DataFrame) -> DataFrame:
        each = to.join(parts.drop("n"), ["tree", "shard"])
        return each.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        array = np.sort(left.column("s").to_numpy())
        found = []
        for s in right.column("s").to_numpy():
            a, b = prefix_ranges(array, int(s), bits)
            found.append((b - a).tolist())
        return pa.table({"key": right.column("key"), "counts": pa.array(found, pa.list_(pa.int64()))})

    counts = (
        placed.select(*at, "s").groupBy(*at).cogroup(posed(questions).select(*at, "key", "s").groupBy(*at))
        .applyInArrow(count, "key bigint, counts array<bigint>")
    )
    if depth:
        # Prefixes shorter than a shard's span several: their entries are those of the shards.
        counts = counts.select("key", F.transform("counts", lambda n, i: F.when(i >= depth, n).otherwise(0)).alias("counts"))
        length = F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("i")
        prefix = F.expr(f"shiftright(shard, {depth} - i)").alias("prefix")
        sizes = parts.select("tree", "shard", "n", length).select("tree", "i", prefix, "n")
        sizes = sizes.groupBy("tree", "i", "prefix").agg(F.sum("n").alias("n"))
        above = questions.select("key", "tree", "shard", length).select("key", "tree", "i", prefix).join(sizes, ["tree", "i", "prefix"])
        counts = counts.unionByName(
            above.select("key", F.expr(f"transform(sequence(0, {bits}), j -> if(j = i, n, 0L))").alias("counts"))
        )
    total = counts.groupBy("key").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(bits + 1)]).alias("counts"))
    reached = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(bits)), lambda i: F.element_at("counts", i + 1) >= enough))
    level = materialize(total.select("key", F.coalesce(reached, F.lit(0)).alias("level")), "levels")
    stopped = questions.join(level, "key")
    if depth:
        below = F.expr(f"cast(greatest({depth} - level, 0) as int)")
        stopped = stopped.withColumn("below", below).withColumn("first", F.expr("shiftleft(shiftright(shard, below), below)"))
        stopped = stopped.withColumn("shard", F.expr("explode(sequence(first, first + shiftleft(1L, below) - 1))"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(left.column("s").to_numpy(), kind="stable")
        array, x = left.column("s").to_numpy()[order], _matrix(left.column("v"), dimensions)[order]
        keys = left.column("key").to_numpy()[order]
        slack = 1e-12 * np.abs(x).sum(axis=1).max(initial=0)  # above the rounding of a product of either kind
        out: list[tuple] = []
        for key, s, stop, q in zip(
            right.column("key").to_pylist(), right.column("s").to_pylist(), right.column("level").to_pylist(), _matrix(right.column("v"), dimensions)
        ):
            a, b = prefix_ranges(array, s, bits)
            lo, hi = int(a[stop]), int(b[stop])
            best = lo + foremost(x[lo:hi] @ q, k + 5, slack * np.abs(q).max(initial=0))
            exact = scores(x[best], q)
            # Of equal scores the smaller ids come first, whatever vectors they belong to.
            first = np.lexsort((keys[best], -exact))[: k + 5]
            out += zip([key] * len(first), keys[best[first]].tolist(), exact[first].tolist())
        names = ("key", "found", "score")
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate(zip(names, kinds))})

    hits = (
        placed.select(*at, "key", "s", "v").groupBy(*at)
        .cogroup(posed(stopped).select(*at, "key", "s", "v", "level").groupBy(*at))
        .applyInArrow(search, "key bigint, found bigint, score double")
        .groupBy("key", "found").agg(F.max("score").alias("score"))
    )
    first = Window.partitionBy("key").orderBy(F.desc("score"), "found")
    best = hits.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 2)
    each = best.join(vectors.select(F.col("key").alias("found"), "ids"), "found").select("key", "score", F.explode("ids").alias("id"))
    closest = materialize(
        each.groupBy("key").agg(
            F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("far"), "id"))), 1, k + 1).alias("near")
        ),
        "closest",
    )
    # Back to every query of the vector; its own id goes.
    named = materialize(distinct.select("key", "v"), "named")
    of = asked.join(named, "v").select("id", "key").distinct()
    mine = of.join(closest, "key").select(
        F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near")
    )
    return mine.select("query_id", F.posexplode("near").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.far") + 0.0).alias("score")
    )
