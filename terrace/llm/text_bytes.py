"""Texts of an Arrow column as bytes, some at a time, and polynomial hashes of parts of them; all in numpy, within tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import common

#: Bytes of text that are taken together.
TOGETHER = 1 << 18
#: Bytes that aren't ASCII white space.
INSIDE = ~np.isin(np.arange(256), list(b" \t\n\v\f\r"))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MULTIPLIER
    return x ^ (x >> np.uint64(29))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a fixed odd number and of its inverse, kept by the worker."""
    kept = common.worker_cache("powers", dict)
    if len(kept.get("up", ())) < n:
        kept["up"], kept["down"] = (np.multiply.accumulate(np.full(n, base, np.uint64)) for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))))
    return kept["up"], kept["down"]


def byte_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, where each row's text starts) of some TOGETHER bytes of texts; a longer text is alone. Null is empty."""
    column = column.cast(pa.binary()) if not pa.types.is_large_string(column.type) else column.cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + TOGETHER, "right")) - 1)
        yield row, raw[offsets[row] : offsets[to]], offsets[row:to] - offsets[row]
        row = to
