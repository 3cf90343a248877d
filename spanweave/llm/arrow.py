"""Arrow columns as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 offsets into them, without copies; a null has no bytes."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)), at


def strings(column: pa.Array) -> list[str | None]:
    """A string column's values; bytes that are no UTF-8, which Spark carries along, are read as U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode(errors="replace") for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
