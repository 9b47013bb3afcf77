"""Sorted 64-bit keys as bytes, and ranges of them, for sending many keys in few rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64


def code(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, byte plane by byte plane: high planes are zeros."""
    steps = np.diff(values, prepend=U(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def decode(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


def pack(*columns: np.ndarray) -> bytes:
    """Rows of 64-bit values, sorted by their first, in few bytes."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns[1:]]
    raw = b"".join([code(columns[0].view(U)), *planes])
    return len(columns[0]).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, n_columns: int) -> list[np.ndarray]:
    """The columns of ``pack``, as unsigned numbers."""
    n = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], 8 * n * n_columns, codec="zstd", asbytes=True)
    cuts = [raw[8 * n * i : 8 * n * (i + 1)] for i in range(n_columns)]
    rest = [np.ascontiguousarray(np.frombuffer(c, np.uint8).reshape(8, -1).T).view(U).ravel() for c in cuts[1:]]
    return [decode(cuts[0]), *rest]


def range_bounds(ranges: int) -> np.ndarray:
    """The first key of each range but the first; ranges cut the 64-bit numbers evenly."""
    return np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=U)
