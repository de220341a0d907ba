"""Batches cut by the size of their texts, so that a few very long texts don't fill a task's memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is a batch of its own.
BATCH_BYTES = 8_000_000


def by_size(batches: Iterator[pa.RecordBatch], *columns: str, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in batches of at most ``limit`` bytes in ``columns``. Empty batches are left out."""
    limit = limit or BATCH_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0)).astype(np.int64) for c in columns)
        if sizes.sum() <= limit:
            yield batch
            continue
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)
