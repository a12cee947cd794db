"""Arrow and numpy helpers for operators that work on column buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column; nulls have no bytes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings data[start:end], gathered in one step."""
    lengths = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    source = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], lengths)
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[source]))])
