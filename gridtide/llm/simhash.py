"""Near-duplicates by 64-bit fingerprints, found through Golay-code fuzzy hashing.

A fingerprint is cut into segments of 21, 21 and 22 bits.  If two fingerprints differ in
at most two bits, then for one of the three ordered pairs (first, second), (second,
third), (third, first) the leading segment is equal and the other differs in at most one
bit (pigeonhole).  So each fingerprint gets, per pair, the keys (pair, leading segment,
index of a codeword near the other segment): up to 18 keys of 34 bits, and linked
fingerprints share one.  Fingerprints that share a key are joined and verified.

Only distinct fingerprints take part, so exact copies cost nothing.  Pairs are verified
where the members of a key lie together, and only the links of a spanning tree leave the
task: fewer than members.  Of a key that more than ``CROWD`` distinct fingerprints share,
no task gets all members: they are linked through the words one bit away from them (65
each; two words share such a midpoint exactly when they differ in at most two bits),
which is exact, linear, and has at most 65 members a midpoint.

Defined cases: NULL text is empty; texts without words have fingerprint zero and are
linked like any other; texts of fewer words than a shingle are one shingle; repeated
shingles count each time; rows with a NULL id take part and do not name a component
(one of NULL ids only has a NULL name); only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gridtide.llm import bitmaps, golay
from gridtide.llm.batches import values
from gridtide.llm.components import components
from gridtide.session import materialize

WORDS = 3
SEED = 42
CHUNK = 1 << 16  # hashes whose bits are counted at once
CROWD = 32  # distinct fingerprints of a key that one task compares
ALL = (1 << 64) - 1
SHIFTS, WIDTHS = (0, 21, 42), (21, 21, 22)
PAIRS = ((0, 1), (1, 2), (2, 0))


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Signed 64-bit fingerprint: a bit is set if over half the shingle hashes have it."""
    from xxhash import xxh64_intdigest

    found = (text or b"").lower().split()  # both know ASCII only: letters, and \x20 \x09-\x0d
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = list(map(len, found))
    ends = [e - 1 for e in accumulate(n + 1 for n in lengths)]
    starts = [e - n for e, n in zip(ends, lengths)]
    last = ends[words - 1 :] or ends[-1:]
    counts, total = np.zeros(64, dtype=np.int64), len(last)
    for k in range(0, total, CHUNK):
        spans = zip(starts[k : k + CHUNK], last[k : k + CHUNK])
        h = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in spans], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp) per row, computed where the row lies."""

    @arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint(t, words) for t in values(texts)], pa.int64())

    return docs.select(F.col(f"`{id_col}`").alias("id"), of(F.col(f"`{text_col}`").cast("binary")).alias("fp"))


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of signed fingerprints and the position of the fingerprint each belongs to."""
    bits = fps.astype(np.int64).view(np.uint64)
    parts = [((bits >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS)]
    keys, owners = [], []
    for p, (exact, fuzzy) in enumerate(PAIRS):
        near = golay.indices(parts[fuzzy])
        at, col = np.nonzero(near >= 0)
        keys.append(p << 40 | parts[exact][at] << 12 | near[at, col])
        owners.append(at)
    return np.concatenate(keys), np.concatenate(owners)


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fps = b["fp"].to_numpy()
        keys, owners = keys_of(fps)
        yield pd.DataFrame({"key": keys, "fp": fps[owners]})


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of at most two bits that connect what such links connect in each group."""
    for batch in batches:
        found: list[tuple[int, int]] = []
        for group in batch.column("fps").to_pylist():
            rest = sorted(group)
            while rest:
                reached = [rest.pop()]
                for x in reached:
                    near = [y for y in rest if ((x ^ y) & ALL).bit_count() <= 2]
                    reached += near
                    found += [(min(x, y), max(x, y)) for y in near]
                    rest = [y for y in rest if y not in near]
        a, b = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those
    of all links of at most two bits."""
    keyed = fps.select("fp").mapInPandas(_keyed, "key bigint, fp bigint")
    shared = materialize(
        keyed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("n > 1"),
        "keys",
        narrow=True,
    )
    members = keyed.join(shared.where("n > 2").select("key", "n"), "key")
    few = members.where(F.col("n") <= CROWD).groupBy("key").agg(F.collect_set("fp").alias("fps"))
    pairs = shared.where("n = 2 and bit_count(a ^ b) <= 2").select("a", "b")
    verified = pairs.unionByName(few.select("fps").mapInArrow(_spanning, "a bigint, b bigint"))
    crowded = members.where(F.col("n") > CROWD).select("fp").distinct()
    middles = crowded.select(
        "fp", F.expr("explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))) AS middle")
    )
    around = middles.groupBy("middle").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    spokes = around.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return verified.unionByName(spokes).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: id, fp and component_id, the smallest id that links
    of at most two differing bits reach."""
    rows = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints", narrow=True)
    fps = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    labels = components(links(fps)).withColumnRenamed("node", "fp")
    named = materialize(fps.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "named")
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    chosen = materialize(named.join(smallest, "label").select("fp", "component_id"), "components")
    return rows.join(chosen, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id."""
    found = near_duplicates(docs, id_col, text_col, words)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col)
    return bitmaps.without(docs, materialize(gone, "dropped", narrow=True), id_col)
