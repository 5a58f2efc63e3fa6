"""Values of Arrow batches, a few rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 256


def values(column: pa.Array) -> Iterator:
    """The values of a batch, of which only ``ROWS`` are Python objects at a time."""
    for at in range(0, len(column), ROWS):
        yield from column.slice(at, ROWS).to_pylist()
