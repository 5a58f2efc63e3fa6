"""Best-fit packing of documents into training sequences of several permitted lengths.

A new sequence may be opened at any permitted length, and when all is placed each shrinks
to the smallest length that holds its contents.  Which lengths to open is decided jointly:
a block of documents is packed (longest first, into the open sequence with the least room
that is enough) once for every length taken as the usual opening length, and once opening
whatever costs least per token still to be placed; the cheapest result counts.

Documents longer than the longest permitted length are cut into pieces of that length and
a rest.  Packing needs ids and lengths only, so texts are not moved: every partition packs
its own rows, in blocks of ``BLOCK`` pieces, and a lost partition is packed again alone
(its rows must come in the same order again, as they do from files).  Which documents share
a sequence, and the ids of sequences, therefore follow the way the table is split into
partitions; another split gives another packing of the same pieces.

``length`` is any column; with the count of ``token_counts.token_counter`` the start and
length of a piece are the span of its token ids in the document.  Lengths that Python has to
count are better counted where the pieces are packed: then ``length`` is what is counted and
``measure`` (``token_counts.token_measure``) counts it, in one worker instead of two.

Defined cases: rows of length NULL, zero or less hold nothing to train on; they come back
with length 0 and no sequence; ties in length go by row order; repeated rows and ids are
packed each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (512, 1024, 2048, 4096, 8192)
BLOCK = 50_000

NAMES = ["id", "piece", "start", "length", "bin_id", "bin_size", "bin_start"]


def words(text: Column) -> Column:
    """Length in words."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def usual_costs(sizes: Sequence[int]) -> dict[int, float]:
    """Cost of training on one sequence: per token, per token pair, and once."""
    return {s: s + s * s / 65_536 + 16 for s in sizes}


class Bins:
    """Open sequences by their room; the least room that is enough is found by bits."""

    def __init__(self, sizes: Sequence[int], costs: Mapping[int, float]):
        self.sizes, self.costs = sorted(sizes), costs
        self.used: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(self.sizes[-1] + 1)]
        self.rooms = 0  # bit r: some open sequence has room r

    def place(self, length: int, opening: int) -> tuple[int, int]:
        """Sequence and offset of a piece; ``opening`` is the length of a new one."""
        fits = self.rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            found = self.by_room[room]
            k = found.pop()
            if not found:
                self.rooms ^= 1 << room
        else:
            k, room = len(self.used), opening
            self.used.append(0)
        at = self.used[k]
        self.used[k] += length
        if room > length:
            self.by_room[room - length].append(k)
            self.rooms |= 1 << (room - length)
        return k, at

    def shrunk(self) -> list[int]:
        return [self.sizes[int(np.searchsorted(self.sizes, u))] for u in self.used]


def pack(lengths: Sequence[int], sizes: Sequence[int], costs: Mapping[int, float]) -> tuple[list[int], list[int], list[int]]:
    """Sequence and offset of each piece and the final lengths of the sequences."""
    sizes = sorted(sizes)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    fitting = {n: [s for s in sizes if s >= n] for n in set(lengths)}
    total, best = sum(lengths), None
    for usual in [*sizes, None]:
        bins, at, rest = Bins(sizes, costs), [(0, 0)] * len(lengths), total
        for i in order:
            n = lengths[i]
            if usual is None:
                opening = min(fitting[n], key=lambda s: costs[s] / min(s, rest))
            else:
                opening = max(usual, fitting[n][0])
            at[i] = bins.place(n, opening)
            rest -= n
        final = bins.shrunk()
        cost = sum(costs[s] for s in final)
        if best is None or cost < best[0]:
            best = cost, at, final
    _, at, final = best
    return [k for k, _ in at], [o for _, o in at], final


def packed(
    docs: DataFrame, length: Column, id_col: str = "doc_id", sizes: Sequence[int] = SIZES,
    costs: Mapping[int, float] | None = None, measure: Callable[[pa.Array], pa.Array] | None = None,
) -> DataFrame:
    """One row per piece: id, piece (from 0), start and length in the document, bin_id,
    bin_size and bin_start, the place in its sequence.  ``costs``: of one sequence of
    each permitted length.  ``measure``: from a batch of ``length`` to lengths."""
    sizes = sorted(set(sizes))
    costs = dict(costs or usual_costs(sizes))
    largest = sizes[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []  # id, piece, start, length

        def flush() -> pa.RecordBatch:
            nonlocal first
            lengths = [r[3] for r in rows if r[3]]
            at, offset, final = pack(lengths, sizes, costs) if lengths else ([], [], [])
            place = iter(zip([first + k for k in at], [final[k] for k in at], offset))
            placed = [(*r, *(next(place) if r[3] else (None, None, None))) for r in rows]
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*placed)], NAMES)
            first += len(final)
            rows.clear()
            return out

        for b in batches:
            lengths = b.column("n") if measure is None else measure(b.column("n"))
            for i, n in zip(b.column("id").to_pylist(), lengths.to_pylist()):
                n = max(n or 0, 0)
                for piece, start in enumerate(range(0, max(n, 1), largest)):
                    rows.append((i, piece, start, min(largest, n - start)))
                    if len(rows) >= BLOCK:
                        yield flush()
        if rows:
            yield flush()

    length = length if measure else length.cast("bigint")
    narrow = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), length.alias("n"))
    return narrow.mapInArrow(run, ", ".join(f"{c} bigint" for c in NAMES)).withColumnRenamed("id", id_col)


def fill_report(rows: DataFrame) -> DataFrame:
    """Per permitted length: sequences, tokens in them, share filled."""
    bins = rows.where("bin_id is not null").groupBy("bin_id", "bin_size").agg(F.sum("length").alias("tokens"))
    return bins.groupBy("bin_size").agg(
        F.count(F.lit(1)).alias("sequences"),
        F.sum("tokens").alias("tokens"),
        (F.sum("tokens") / F.sum("bin_size")).alias("filled"),
    )
