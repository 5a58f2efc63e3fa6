"""Mixing sources to target weights along a curriculum.

Every source has a weight schedule: a piecewise linear function of the training progress,
from 0 to 1.  Its integral is the source's weight; weights share the words of the whole
corpus, and a source that would have to be read more than ``most`` times stops there, its
excess going to the others by weight (a water level, found by a few sums over the table of
sources).  The integral up to t, scaled to the target, is the demand for words of the
source until t.  Documents of a source stand in the order of a digest of their id, once
per reading; the words before a document are therefore the demand at which it is due, and
the inverse of the demand (a quadratic in each piece of the schedule) its position.  The
copies of all documents are range-sorted by position.

The last reading of a source is one in part.  A document takes part in it if its middle
lies within the words still wanted; then the one document that brings the sum nearest to
the target is added or left out.  Texts are not moved: the plan is made of ids and sizes.

How it scales: a source is cut into blocks of the digest's range, in proportion to its
rows, so that a source with a third of all rows is spread like the others; the words
before a block are sums over one row per block.  Texts are read once.

Defined cases: NULL text has size 0; documents without words are never taken; NULL is a
source like any other; a source without a schedule, with fewer than two knots or with no
weight gets no words (weights below zero count as zero); a corpus of fewer words than the
weighted sources may give is read ``most`` times; repeated rows and ids are documents each
(NULL ids too); ties in the digest go by size; an empty table gives empty results; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.llm.packing import words
from gridtide.llm.ranks import ranked
from gridtide.session import materialize

MOST = 3  # readings of a source
SPLIT = 8  # blocks of the digest's range per shuffle partition, over all sources


@dataclass(frozen=True)
class Mix:
    """``documents``: row, id, size, source, source_size, target, copies, one row each;
    ``order``: position, row, id, copy (from 0), size, one row per copy, sorted by position."""

    documents: DataFrame
    order: DataFrame


def measured(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """(row, id, source, size) as a written table."""
    size = words(F.col("text")) if size is None else size
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").alias("source"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"),
    )
    return materialize(rows, "sizes")


def sources_of(rows: DataFrame) -> DataFrame:
    """(source, source_size, documents, place) as a table; place is the rank (from 0) by
    code point, NULL last."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    return materialize(ranked(sums, [F.col("source").asc_nulls_last()], name="place"), "sources")


def schedule(weight: Column, start: float, end: float) -> Column:
    """Knots of a weight that moves evenly from ``start`` to ``end`` times its value."""
    def knot(at: float, factor: float) -> Column:
        return F.struct(F.lit(at).alias("at"), (weight * factor).cast("double").alias("weight"))

    return F.array(knot(0.0, start), knot(1.0, end))


def cycled(sources: DataFrame, weights: Sequence[float], moves: Sequence[tuple[float, float]]) -> DataFrame:
    """Sources with schedules (knots) that repeat in the order of the sources."""
    def pick(values: Sequence[float]) -> Column:
        listed = F.array(*[F.lit(float(v)) for v in values])
        return F.element_at(listed, (F.col("place") % len(values) + 1).cast("int"))

    by_move = F.lit(None)
    for k, (start, end) in reversed(list(enumerate(moves))):
        by_move = F.when(F.col("place") % len(moves) == k, schedule(pick(weights), start, end)).otherwise(by_move)
    return sources.withColumn("knots", by_move)


#: Pieces of a schedule: where each begins, its weight there, how the weight grows, and the
#: integral before and after it.
_PIECES = """
transform(sequence(0, size(knots) - 2), i -> named_struct(
  'at', knots[i].at, 'wide', knots[i + 1].at - knots[i].at, 'low', knots[i].weight, 'high', knots[i + 1].weight,
  'area', (knots[i + 1].at - knots[i].at) * (knots[i].weight + knots[i + 1].weight) / 2))
"""
_SUMMED = """
transform(pieces, (p, i) -> named_struct('at', p.at, 'low', p.low, 'area', p.area,
  'slope', if(p.wide > 0, (p.high - p.low) / p.wide, 0D),
  'before', aggregate(slice(pieces, 1, i), 0D, (a, x) -> a + x.area)))
"""


def integrated(sources: DataFrame) -> DataFrame:
    """Sources with ``pieces`` of their schedule and ``weight``, its integral."""
    clean = F.transform(
        F.array_sort(F.filter("knots", lambda k: k["at"].isNotNull() & k["weight"].isNotNull())),
        lambda k: F.struct(k["at"].cast("double").alias("at"), F.greatest(k["weight"].cast("double"), F.lit(0.0)).alias("weight")),
    )
    usable = sources.withColumn("knots", F.when(F.size(clean) >= 2, clean))
    pieces = usable.withColumn("pieces", F.expr(_PIECES)).withColumn("pieces", F.expr(_SUMMED))
    weight = F.coalesce(F.aggregate("pieces", F.lit(0.0), lambda a, p: a + p["area"]), F.lit(0.0))
    return pieces.withColumn("weight", weight).drop("knots")


def with_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Sources with ``target``: their share by weight, at most ``most`` times their size,
    what is over reshared until none is above."""
    sources = materialize(integrated(sources), "weighted")
    limit, level, over = F.col("source_size") * most, 0.0, -1
    while True:
        capped = (F.col("weight") > 0) & (F.lit(level) * F.col("weight") > limit)
        sums = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(capped, limit)).alias("held"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"), F.count_if(capped).alias("over"),
        ).first()
        if sums["over"] == over or not sums["open"]:
            break
        over, level = sums["over"], ((sums["all"] or 0) - (sums["held"] or 0)) / sums["open"]
    return sources.withColumn("target", F.least(limit.cast("double"), F.lit(level) * F.col("weight")))


def _positions(due: DataFrame, words_before: Column) -> DataFrame:
    """``due`` with ``position``: the progress at which the demand for a source's words
    reaches ``words_before``."""
    area = F.least(words_before / F.col("target"), F.lit(1.0)) * F.col("weight")
    piece = F.expr("coalesce(filter(pieces, p -> area <= p.before + p.area)[0], element_at(pieces, -1))")
    rest = F.greatest(F.col("area") - F.col("piece.before"), F.lit(0.0))
    low, slope = F.col("piece.low"), F.col("piece.slope")
    root = low + F.sqrt(F.greatest(low * low + 2 * slope * rest, F.lit(0.0)))
    at = F.col("piece.at") + F.when(rest > 0, 2 * rest / root).otherwise(0.0)
    return due.withColumn("area", area).withColumn("piece", piece).withColumn("position", F.least(at, F.lit(1.0)))


def mix(rows: DataFrame, sources: DataFrame, most: int = MOST) -> Mix:
    """The training order of ``rows`` (of ``measured``) by the schedules of ``sources``
    (of ``sources_of``, with ``knots``: array of (at, weight))."""
    spark = rows.sparkSession
    parts = SPLIT * int(spark.conf.get("spark.sql.shuffle.partitions"))
    planned = with_targets(sources, most)
    all_rows = F.lit(max(planned.agg(F.sum("documents")).first()[0] or 0, 1))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    planned = materialize(
        planned.withColumn("full", full.cast("bigint"))
        .withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
        .withColumn("blocks", F.ceil(F.col("documents") * parts / all_rows)),
        "planned",
    )

    key = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")).cast("binary"))
    share = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2**32
    keyed = (
        rows.alias("d").join(planned.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("d.row", "d.id", "d.size", "s.place", "s.rest", "s.blocks")
        .withColumn("key", key)
        .withColumn("block", F.floor(share * F.col("blocks")))
    )
    sums = keyed.groupBy("place", "block").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("place").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("place", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("place", "block").orderBy("key", "size", "row")
    before = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = materialize(
        keyed.withColumn("inner", before).join(starts, ["place", "block"])
        .withColumn("middle", F.col("start") + F.col("inner") + F.col("size") / 2)
        .select("row", "id", "size", "place", "key", "middle", ((F.col("middle") < F.col("rest")) & (F.col("size") > 0)).alias("again")),
        "placed",
    )

    # What the last reading is short of (or over), and the document that mends it best.
    read = placed.groupBy("place").agg(F.coalesce(F.sum(F.when(F.col("again"), F.col("size"))), F.lit(0)).alias("words"))
    gaps = read.join(planned.select("place", "rest"), "place").select("place", (F.col("rest") - F.col("words")).alias("gap"))
    left = F.abs(F.abs("gap") - F.col("size"))
    helps = (F.col("again") == (F.col("gap") < 0)) & (F.col("size") > 0) & (left < F.abs("gap"))
    mends = (
        placed.join(gaps, "place").where(helps).groupBy("place")
        .agg(F.min(F.struct(left.alias("left"), "key", "size", "row")).alias("best"))
        .select("place", F.col("best.row").alias("row"), F.lit(True).alias("mended"))
    )
    facts = planned.select("place", "source", "source_size", "target", "rest", "full", "weight", "pieces")
    documents = materialize(
        placed.join(materialize(mends, "mends"), ["place", "row"], "left")
        .withColumn("again", F.col("again") != F.coalesce("mended", F.lit(False)))
        .join(facts.drop("weight", "pieces", "rest"), "place")
        .withColumn("copies", F.when(F.col("size") > 0, F.col("full") + F.col("again").cast("bigint")).otherwise(0))
        .select("row", "id", "size", "place", "source", "source_size", "target", "full", "middle", "copies"),
        "documents",
    )

    copies = documents.where("copies > 0").select("row", "id", "size", "place", "full", "middle", F.expr("explode(sequence(0L, copies - 1)) AS copy"))
    due = copies.join(facts.select("place", "source_size", "target", "rest", "weight", "pieces"), "place")
    inner = F.when(F.col("copy") == F.col("full"), F.least("middle", "rest")).otherwise(F.col("middle"))
    order = _positions(due, F.col("copy") * F.col("source_size") + inner).select("position", "row", "id", "copy", "size")
    by = [F.col("position"), F.col("id"), F.col("copy"), F.col("row")]
    return Mix(
        documents.select("row", "id", "size", "source", "source_size", "target", "copies"),
        materialize(order.repartitionByRange(*by).sortWithinPartitions(*by), "order"),
    )


def taken(mixed: Mix, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, size, source_size, target and taken, its words in the order."""
    read = mixed.order.groupBy("row").agg(F.sum("size").alias("taken"))
    return mixed.documents.join(read, "row", "left").select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )


def in_order(docs: DataFrame, mixed: Mix, id_col: str = "doc_id") -> DataFrame:
    """``docs`` (with unique ids) as the training reads them: one row per copy, sorted by
    ``position``, with ``copy``; columns of these names are replaced.  This moves whole
    texts once, as any reordering has to."""
    own = [c for c in docs.columns if c not in ("position", "copy")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc"), F.col(f"`{id_col}`").alias("id"))
    due = rows.join(mixed.order.select("position", "copy", "id"), "id")
    by = [F.col("position"), F.col("id"), F.col("copy")]
    moved = due.repartitionByRange(*by).sortWithinPartitions(*by)
    return moved.select(*[F.col("doc")[c].alias(c) for c in own], "position", "copy")
