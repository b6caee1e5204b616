"""Arrow batches in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def pieces(batches: Iterator[pa.RecordBatch], max_rows: int = 512, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that Python objects made from one piece stay small, however long the texts."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(max_rows, batch.num_rows - at)
            while n > 1 and _bytes(batch, at, n) > max_bytes:
                n //= 2
            yield batch.slice(at, n)
            at += n


def _bytes(batch: pa.RecordBatch, at: int, n: int) -> int:
    return batch.slice(at, n).nbytes
