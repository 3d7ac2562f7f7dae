"""Going through sorted batches group by group inside a task."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of equal first ``keys`` columns, which must be sorted by them; only one group is held at a time."""
    for key, rows in itertools.groupby(rows_of(batches), key=lambda r: r[:keys]):
        yield key, list(rows)
