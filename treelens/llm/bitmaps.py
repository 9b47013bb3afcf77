"""Bitmaps of 64-bit keys: which keys may be in a table, in bounded memory.

A bitmap has false positives, never false negatives; what it lets through is decided by
the table itself. Its size does not grow with the table: a full bitmap lets all through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.llm.coded import pack, unpack

#: Bits of a bitmap: 2^27, 16 MB.
BITS = 27
U = np.uint64


class Bitmap:
    """The words of a bitmap; compressed where it is sent, as a broadcast lies on every machine's disk."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __getstate__(self) -> bytes:
        return zlib.compress(self.words, 1)

    def __setstate__(self, state: bytes) -> None:
        self.words = np.frombuffer(zlib.decompress(state), U)


def has(bitmap: Bitmap, keys: np.ndarray) -> np.ndarray:
    place = keys >> U(64 - BITS)
    return (bitmap.words[place >> U(6)] >> (place & U(63)) & U(1)).astype(bool)


def words_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word of the bitmap, its bits) of sorted places."""
    words = places >> U(6)
    at = np.flatnonzero(np.concatenate([words[:1] == words[:1], words[1:] != words[:-1]]))
    return words[at], np.bitwise_or.reduceat(U(1) << (places & U(63)), at) if len(at) else places


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (at, bits) rows of a batch as one row: steps between words, then their bits."""
    for batch in batches:
        at, bits = batch.column("at").to_numpy(), batch.column("bits").to_numpy()
        order = np.argsort(at)
        steps = np.diff(at[order], prepend=0).astype(np.int32)
        blob = zlib.compress(steps.tobytes() + bits[order].tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])


def gathered(rows: DataFrame) -> Bitmap:
    """The bitmap of (at, bits) rows; at most 2^(BITS - 6) come to the driver, packed by batches."""
    found = rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).mapInArrow(_packed, "blob binary").toArrow()
    out = np.zeros(1 << (BITS - 6), dtype=U)
    for blob in found.column("blob"):
        data = zlib.decompress(blob.as_buffer())
        n = len(data) // 12
        out[np.cumsum(np.frombuffer(data, np.int32, n))] = np.frombuffer(data, U, n, 4 * n)
    return Bitmap(out)


def bitmap(keys: DataFrame, key: str = "key") -> Bitmap:
    """The bits of all ``key``, a column of longs."""
    place = F.shiftrightunsigned(key, 64 - BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({key}, {64 - BITS}) & 63 AS int))")
    return gathered(keys.select(F.shiftrightunsigned(place, 6).alias("at"), bit.alias("bits")))


# bits made in Python, which come to the driver by parts of the bitmap

PARTS = 256
PART = "part int, blob binary"
_PART_BITS = U(BITS - 6 - 8)
#: Keys whose bits are gathered at once.
HELD = 1_000_000


def parts_of(keys: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Parts of the bitmap and their packed words and bits, of keys in any order."""
    at, bits = words_of(np.sort(keys >> U(64 - BITS)))
    cuts = [0, *np.searchsorted(at >> _PART_BITS, np.arange(1, PARTS, dtype=U)).tolist(), len(at)]
    some = [i for i in range(PARTS) if cuts[i] < cuts[i + 1]]
    return some, [pack(at[cuts[i] : cuts[i + 1]], bits[cuts[i] : cuts[i + 1]]) for i in some]


def part_rows(keys: np.ndarray) -> pa.RecordBatch:
    some, blobs = parts_of(keys)
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def _send_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy().view(U))
        n += batch.num_rows
        if n > HELD:
            yield part_rows(np.concatenate(held))
            held, n = [], 0
    if n:
        yield part_rows(np.concatenate(held))


def _join_part(table: pa.Table) -> pa.Table:
    part, out = table.column("part")[0].as_py(), np.zeros(1 << int(_PART_BITS), dtype=U)
    for blob in table.column("blob"):
        at, bits = unpack(blob.as_py(), 2)
        out[at & U(len(out) - 1)] |= bits
    at = np.flatnonzero(out)
    return pa.table({"part": pa.array([part], pa.int32()), "blob": pa.array([pack(at.astype(U), out[at])], pa.binary())})


def joined(parts: DataFrame) -> Bitmap:
    """The bitmap of (part, blob) rows; one row for a part comes to the driver."""
    found = parts.groupBy("part").applyInArrow(_join_part, PART).toArrow()
    out = np.zeros((PARTS, 1 << int(_PART_BITS)), dtype=U)
    for part, blob in zip(found.column("part").to_pylist(), found.column("blob")):
        at, bits = unpack(blob.as_py(), 2)
        out[part, at] = bits
    return Bitmap(out.ravel())


def bits_of(keys: DataFrame) -> Bitmap:
    """The bits of the only column, longs; like ``bitmap``, for many keys."""
    return joined(keys.mapInArrow(_send_bits, PART))
