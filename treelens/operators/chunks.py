"""Content-defined chunking, range covering, inventories and the chunk stream codec."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treelens.sources.workers import ship


#: Bytes of a file whose running hashes are held at once.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Params:
    """Bounds of a chunk; sizes in bytes. Parameters are data, kept per library."""

    least: int = 64
    target: int = 256
    most: int = 1024
    level: int = 2
    seed: bytes = b"treelens"

    def check(self) -> None:
        """Refuse parameters under which cutting makes no sense."""
        if not 0 < self.least <= self.target <= self.most:
            raise ValueError("least <= target <= most must hold")
        if not 0 <= self.level <= 3 or self.bits - self.level < 1 or self.bits + self.level > 63:
            raise ValueError("level out of range")

    @property
    def bits(self) -> int:
        return self.target.bit_length() - 1


def gear_table(seed: bytes) -> list[int]:
    """256 64-bit words expanded from a seed (HKDF with SHA-256)."""
    key = hmac.new(b"\0" * 32, seed, hashlib.sha256).digest()
    block, stream = b"", b""
    for i in range(1, 65):
        block = hmac.new(key, block + b"gear" + bytes([i]), hashlib.sha256).digest()
        stream += block
    return [int.from_bytes(stream[8 * i : 8 * i + 8], "little") for i in range(256)]


def top_mask(bits: int) -> int:
    return ((1 << bits) - 1) << (64 - bits)


def _gear_hashes(words: np.ndarray) -> np.ndarray:
    """The gear hash at every place, started at the first: a word's shift grows by one per place, so 64
    words matter. Windows are doubled six times."""
    h, reach = words.copy(), 1
    while reach < 64 and reach < len(h):
        h[reach:] += h[:-reach] << np.uint64(reach)  # the right side is a copy
        reach *= 2
    return h


def cut_points(data: bytes, params: Params, table: list[int]) -> list[int]:
    """Ends of the chunks. Up to the target a stricter mask is used, beyond it a laxer one.

    A chunk's hash starts before its least size; 63 places later it equals the hash that runs
    through the whole file, whose hits are found block by block.
    """
    strict, lax = (np.uint64(top_mask(params.bits + x)) for x in (params.level, -params.level))
    words, raw, n = np.array(table, np.uint64), np.frombuffer(data, np.uint8), len(data)
    hits: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for begin in range(0, n, BLOCK):
        lead = min(begin, 63)
        h = _gear_hashes(words[raw[begin - lead : begin + BLOCK]])[lead:]
        for found, mask in zip(hits, (strict, lax)):
            found.append(np.flatnonzero((h & mask) == 0) + begin)
    at_strict, at_lax = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in hits)

    def first(places: np.ndarray, low: int, high: int) -> int | None:
        k = np.searchsorted(places, low)
        return int(places[k]) if k < len(places) and places[k] < high else None

    ends, start = [], 0
    while start < n:
        stop = min(n, start + params.most)
        if n - start > params.least:
            begin, turn = start + params.least - 1, start + params.target
            warm = min(begin + 63, stop)
            head = _gear_hashes(words[raw[begin:warm]])
            masks = np.where(np.arange(begin, warm) < turn, strict, lax)
            early = np.flatnonzero((head & masks) == 0)
            at = begin + int(early[0]) if len(early) else first(at_strict, warm, min(turn, stop))
            at = first(at_lax, max(warm, turn), stop) if at is None else at
            stop = stop if at is None else at + 1
        ends.append(stop)
        start = stop
    return ends


def _chunk(batches: Iterator[pd.DataFrame], params: Params) -> Iterator[pd.DataFrame]:
    table = gear_table(params.seed)
    for b in batches:
        rows = []
        for doc, text in zip(b["file_id"], b["text"]):
            data, start = (text or "").encode(), 0
            for seq, end in enumerate(cut_points(data, params, table)):
                rows.append((doc, seq, start, end - start, hashlib.sha256(data[start:end]).hexdigest()))
                start = end
        yield pd.DataFrame(rows, columns=["file_id", "seq", "off", "size", "chunk_id"])


def chunk_files(files: DataFrame, params: Params = Params()) -> DataFrame:
    """(file_id, seq, off, size, chunk_id) of (file_id, text); an empty file has no chunk."""
    params.check()
    ship(files.sparkSession)
    return files.select("file_id", "text").mapInPandas(
        partial(_chunk, params=params), "file_id long, seq int, off long, size long, chunk_id string"
    )


def dedup_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, distinct chunks, bytes, distinct bytes."""
    per = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    return per.agg(
        F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("distinct_chunks"),
        F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("size").alias("distinct_bytes"),
    )


def covering(chunks: DataFrame, ranges: DataFrame, limit: int | None = None) -> DataFrame:
    """(manifest_id, seq) of the chunks that any range touches, each once.

    ``ranges`` has manifest_id, lo and n; a negative length means to the end; what lies
    outside the file is cut off, an empty range touches nothing. With a ``limit``, a file whose ranges
    touch more chunks is refused: the query ends in an error.
    """
    begin = F.greatest(F.col("lo"), F.lit(0))
    end = F.when(F.col("n") < 0, F.lit(1 << 62)).otherwise(F.col("lo") + F.col("n"))
    r = ranges.select("manifest_id", begin.alias("b"), end.alias("e")).filter("b < e")
    hit = (F.col("off") < F.col("e")) & (F.col("off") + F.col("size") > F.col("b"))
    out = chunks.join(r, "manifest_id").filter(hit).select("manifest_id", "seq").distinct()
    if limit is None:
        return out
    n = F.count(F.lit(1)).over(Window.partitionBy("manifest_id"))
    refused = F.raise_error(F.lit(f"the ranges touch more than {limit} chunks")).cast("boolean")
    return out.withColumn("n", n).filter(F.when(F.col("n") > limit, refused).otherwise(F.lit(True))).drop("n")


def inventory(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """(chunk_id, first_pos, times, size): distinct asked ids in order of first mention; a missing one has no size."""
    once = asked.groupBy("chunk_id").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("times"))
    return once.join(stored.select("chunk_id", "size"), "chunk_id", "left")


def encode_frames(frames: list[tuple[bytes, bytes | None]]) -> bytes:
    """A self-describing stream: 32-byte id, a presence byte, length, bytes; then a terminator."""
    out = bytearray()
    for key, data in frames:
        if len(key) != 32 or not any(key):
            raise ValueError("an id has 32 bytes, not all zero")
        out += key + (b"\x01" + len(data).to_bytes(4, "big") + data if data is not None else b"\x00")
    return bytes(out + b"\0" * 32)


def decode_frames(stream: bytes) -> list[tuple[bytes, bytes | None]]:
    """The frames of a stream; one that is cut short or goes on after its end is refused."""
    out, at = [], 0
    while True:
        key = stream[at : at + 32]
        if len(key) < 32:
            raise ValueError("the stream ends without its terminator")
        at += 32
        if not any(key):
            if at != len(stream):
                raise ValueError("bytes after the terminator")
            return out
        flag = stream[at : at + 1]
        at += 1
        if flag == b"\x00":
            out.append((key, None))
            continue
        if flag != b"\x01" or at + 4 > len(stream):
            raise ValueError("malformed frame")
        size = int.from_bytes(stream[at : at + 4], "big")
        at += 4
        if at + size > len(stream):
            raise ValueError("the stream is cut short")
        out.append((key, stream[at : at + size]))
        at += size


def stream_chunks(frames: DataFrame) -> DataFrame:
    """(manifest_id, stream) of (manifest_id, seq, chunk_id, data): a file's frames in order; null data is absent.

    A file's frames are one row, as its stream is one answer.
    """
    ship(frames.sparkSession)
    row = F.struct("seq", "chunk_id", "data")
    files = frames.groupBy("manifest_id").agg(F.array_sort(F.collect_list(row)).alias("frames"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [encode_frames([(bytes.fromhex(f["chunk_id"]), f["data"]) for f in fs]) for fs in b["frames"]]
            yield pd.DataFrame({"manifest_id": b["manifest_id"], "stream": made})

    return files.mapInPandas(encode, "manifest_id long, stream binary")


def read_streams(streams: DataFrame) -> DataFrame:
    """(manifest_id, ord, chunk_id, data) of (manifest_id, stream); malformed streams end in an error."""
    ship(streams.sparkSession)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(m, i, k.hex(), d) for m, x in zip(b["manifest_id"], b["stream"]) for i, (k, d) in enumerate(decode_frames(bytes(x)))]
            yield pd.DataFrame(rows, columns=["manifest_id", "ord", "chunk_id", "data"])

    return streams.mapInPandas(decode, "manifest_id long, ord int, chunk_id string, data binary")
