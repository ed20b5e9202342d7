"""Arrow batches of documents inside Python workers, bounded by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows and bytes of text that a worker handles at once; a longer text is handled alone.
ROWS, BYTES = 2048, 8 << 20


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in batches of at most ``rows`` rows and about ``most`` bytes of ``text``."""
    for batch in batches:
        column, start = batch.column(batch.schema.get_field_index(text)), 0
        while start < batch.num_rows:
            n = min(rows, batch.num_rows - start)
            while n > 1 and column.slice(start, n).nbytes > most:
                n = max(1, n // 2)
            yield batch.slice(start, n)
            start += n


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings, null as the empty string."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]
