"""Helpers shared by the operators that run Arrow batches through Python."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def sliced(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most_bytes`` of ``text`` (one row at least).

    Memory in the worker then follows the longest text, not the number of rows in a batch.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        offsets = column.buffers()[1]
        width = 8 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else 4
        ends = memoryview(offsets).cast("q" if width == 8 else "i")[column.offset : column.offset + len(column) + 1]
        begin = 0
        while begin < batch.num_rows:
            end = begin + 1
            while end < batch.num_rows and ends[end + 1] - ends[begin] <= most_bytes:
                end += 1
            yield batch.slice(begin, end - begin)
            begin = end
