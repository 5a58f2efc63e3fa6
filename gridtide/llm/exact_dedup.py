"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each level passes on only the rows that share their key with another row.  What a level
learns travels as a bitmap of bounded size, so no text is ever shuffled: levels exchange
partial counts of narrow keys, and the last one exchanges (id, digest).

Defined cases: NULL text equals the empty text.  Texts are equal when identical after
runs of ASCII white space become one space.  Of equal texts the smallest id stays; rows
with a NULL id never stay beside one with an id, and of a group of NULL ids every row
stays, as nothing tells them apart.  Rows repeated with the same id are one document and
are marked alike.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.llm import bitmaps
from gridtide.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
PREFIX = 128  # characters of the second level


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _shared(rows: DataFrame, key: Column, bits: int) -> DataFrame:
    """Bitmap of the keys that more than one row has."""
    counts = rows.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return bitmaps.pages(counts.where("n > 1"), F.col("k"), bits)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest_all: bool = False
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept and digest (SHA-256 of
    the normalised text as 32 bytes; without ``digest_all`` only where two levels could
    not tell the text from another)."""
    bits = bitmaps.size_for(docs.count())
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("body"))
    length = F.char_length("body").cast("bigint")
    start = F.xxhash64(length, F.substring("body", 1, prefix))

    same_length = bitmaps.marked(rows, length, _shared(rows, length, bits), bits, "level1")
    two = _shared(same_length.where("level1"), start, bits)
    same_start = bitmaps.marked(same_length, start, two, bits, "level2").withColumn(
        "level2", F.col("level1") & F.col("level2")
    )
    wanted = F.lit(True) if digest_all else F.col("level2")
    hashed = materialize(
        same_start.select("id", "level2", F.when(wanted, F.unhex(F.sha2("body", 256))).alias("digest")), "digests", narrow=True
    )
    groups = materialize(
        hashed.where("level2")
        .groupBy("digest")
        .agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
        .withColumnRenamed("digest", "key"),
        "copies",
    )
    # Rows that survived alone get a key of their own, so that they do not meet in one task.
    own = F.concat(F.lit("id").cast("binary"), F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    key = F.when(F.col("level2"), F.col("digest")).otherwise(own)
    joined = hashed.withColumn("key", key).join(groups, "key", "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("keep", "id").alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce("keep", "id").eqNullSafe(F.col("id")).alias("kept"),
        "digest",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row with a smaller id has.  Rows with
    a NULL id stay: a decision by id cannot name them."""
    marks = exact_duplicates(docs, id_col, text_col)
    return bitmaps.without(docs, materialize(marks.where("not kept").select(id_col), "dropped", narrow=True), id_col)
