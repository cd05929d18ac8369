"""Helpers for kernels over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[pa.Table]:
    """Whole groups of equal ``by`` out of a stream sorted by them; only the current group is held."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        columns = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in by]
        new = np.zeros(b.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        if held:
            new[0] = any(held[-1].column(held[-1].schema.get_field_index(n))[-1].as_py() != c[0] for n, c in zip(by, columns))
        starts = np.flatnonzero(new)
        first = starts[0] if len(starts) else b.num_rows
        if first:
            held.append(b.slice(0, first))
        for lo, hi in zip(starts, [*starts[1:], b.num_rows]):
            if held:
                yield pa.Table.from_batches(held)
            held = [b.slice(lo, hi - lo)]
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column of packed doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def packed(x: np.ndarray) -> pa.Array:
    """A binary column of packed doubles."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x, np.float64)], pa.binary())
