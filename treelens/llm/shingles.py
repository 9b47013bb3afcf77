"""Vectorised words and word shingles of whole texts (NumPy).

A batch of texts is one byte buffer; words are hashed with a polynomial prefix
sum, so no Python object is made per word. Hashes are 64-bit; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.default_rng(20240229)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_VALUE[65:91] = _VALUE[97:123]
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes handled at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _powers:
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers.clear()
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of bounded size; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    solid = np.ones(n + 2, dtype=bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[data], out=solid[1:-1])
    first = np.zeros(n + 1, dtype=bool)  # a text's first byte begins a word even without a space before
    first[offsets[:-1]] = True
    last = np.zeros(n + 1, dtype=bool)
    last[offsets[1:]] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | first[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | last[1:])) + 1
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, offsets)
    return hashes, np.diff(bounds)


_SOLID = bytes(0 if _SPACE[i] else 1 for i in range(256))
_LOWER = bytes(i + 32 if 65 <= i < 91 else i for i in range(256))
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=U)
#: Bytes of a word from which ``word_keys`` takes its polynomial hash.
LONG_WORD = 128


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like ``word_hashes``, by other hashes that take eight bytes of a word at once."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    raw = data.tobytes()
    solid = np.frombuffer(b"\0" + raw.translate(_SOLID) + b"\0", dtype=bool)
    inner = np.unique(offsets[(offsets > 0) & (offsets < n)])
    joints = inner[solid[inner] & solid[inner + 1]]  # a text ends and another begins without a space
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    if len(joints):
        edges = np.sort(np.concatenate([edges, joints, joints]))
    starts, ends = edges[::2], edges[1::2]
    eights = np.frombuffer(raw.translate(_LOWER) + b"\0" * (16 - n % 8), dtype="<u8")
    sizes = ends - starts

    def eight(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The bytes from ``at``, eight at most."""
        i, shift = at >> 3, ((at & 7) << 3).astype(U)
        both = (eights[i] >> shift) | (eights[i + 1] << U(1) << (U(63) - shift))
        return both & _FIRST[np.minimum(left, 8)]

    hashes = mix(eight(starts, sizes) + sizes.astype(U) * _BASE)
    more = np.flatnonzero(sizes > 8)
    if len(more) and sizes[more].max() >= LONG_WORD:
        polynomial = np.flatnonzero(sizes >= LONG_WORD)
        hashes[polynomial] = word_hashes(data, offsets)[0][polynomial]
        more = more[sizes[more] < LONG_WORD]
    done = 8
    while len(more):
        hashes[more] = mix(hashes[more] * _INVERSE + eight(starts[more] + done, sizes[more] - done))
        done += 8
        more = more[sizes[more] > done]
    return hashes, np.diff(np.searchsorted(starts, offsets))


_PLACE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * U(2) + U(1)


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts in turn, set size of each text).

    A text with fewer words than ``width`` has its whole sequence as one shingle;
    a text without words has the empty set.
    """
    ends = np.cumsum(counts)
    begins = ends - counts
    if len(hashes) >= width:
        m = len(hashes) - width + 1
        rolled = hashes[:m] * _PLACE[0]
        for j in range(1, width):
            rolled = rolled + hashes[j : j + m] * _PLACE[j]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i in range(len(counts)):
        b, c = begins[i], counts[i]
        if c >= width:
            s = np.unique(rolled[b : b + c - width + 1])
        elif c:
            part = hashes[b : b + c] * _PLACE[:c]
            s = mix(part.sum(dtype=np.uint64, keepdims=True) + U(int(c)))
        else:
            continue
        out.append(s)
        sizes[i] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes
