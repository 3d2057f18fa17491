"""Bounded pieces of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# What a task works on at a time; a single longer row is a piece of its own.
PIECE_BYTES = 4_000_000


def pieces(batch: pa.RecordBatch, sizes: np.ndarray, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of which the ``sizes`` sum up to ``most`` at most."""
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and held + size > most:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)
