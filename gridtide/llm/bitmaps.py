"""Sets of 64-bit keys as broadcast bitmaps of bounded size.

A key sets the bit ``key mod bits``.  A clear bit proves that a key is absent; a set bit
may be a coincidence, so what follows it is exact.  The bitmap has at most ``MAX_BITS``
bits (32 MB) whatever the number of keys, which is what allows the broadcast; beyond
that size more coincidences pass and only the saving shrinks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 32_768  # bits of one aggregated bitmap row
MAX_BITS = 1 << 28


def size_for(rows: int) -> int:
    """Bits for about ``rows`` keys: 16 a key up to the bound, a power of two."""
    return min(MAX_BITS, max(PAGE, 1 << (16 * max(rows, 1) - 1).bit_length()))


def pages(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """One row (page, bitmap) per page that has a key; NULL keys set no bit."""
    slot = F.pmod(key, F.lit(bits))
    return (
        keys.where(key.isNotNull())
        .groupBy(F.floor(slot / PAGE).alias("page"))
        .agg(F.bitmap_construct_agg(slot % PAGE).alias("bitmap"))
    )


def marked(df: DataFrame, key: Column, table: DataFrame, bits: int, name: str) -> DataFrame:
    """``df`` with the boolean ``name``: whether the bit of ``key`` is set."""
    slot = F.pmod(key, F.lit(bits))
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.floor(slot / PAGE).alias("page"),
        (slot % PAGE).alias("at"),
    )
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10)
    bit = F.getbit(byte.cast("bigint"), (F.col("at") % 8).cast("int"))
    return packed.join(F.broadcast(table), "page", "left").select(
        "row.*", F.coalesce(bit == 1, F.lit(False)).alias(name)
    )


def without(df: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id is not in ``gone`` (one column of that name).

    Rows whose bit is clear pass where they lie; only the others, which are the rows to
    drop and a few coincidences, are shuffled for the exact anti-join.  The coincidences
    (up to one row in 16, more for a bitmap at its bound) are gathered into few partitions.
    Rows with a NULL id stay.  All columns come back as they were.
    """
    bits = size_for(gone.count())
    key = F.xxhash64(F.col(f"`{id_col}`"))
    known = F.col(f"`{id_col}`").isNotNull()
    table = pages(gone.where(known), key, bits)
    cols = [F.col(f"row.`{c}`").alias(c) for c in df.columns]
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
    )
    seen = marked(rows, F.xxhash64("id"), table, bits, "hit")
    suspect = F.col("hit") & F.col("id").isNotNull()
    ids = gone.select(F.col(f"`{id_col}`").alias("id")).where("id is not null").distinct()
    return seen.where(~suspect).select(*cols).unionByName(
        seen.where(suspect).join(ids, "id", "left_anti").select(*cols).hint("rebalance")
    )
