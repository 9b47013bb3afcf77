"""Token-ID output: Parquet files of token lists in ascending document order.

Documents are range-partitioned and sorted by id, or by what the caller names, encoded partition by partition and
written as one file each. A row holds the id, the token count, where the document
starts in its file, the file's number, and the list of ids. Token lists are dictionary
encoded (the vocabulary fits a dictionary page), the metadata columns delta encoded;
row groups and pages are small and page indexes are written, so that single
documents or the metadata alone can be read without the tokens.

Defined results: a null or empty text has only the end id; null ids come first;
rows with one id are ordered by a hash of the text; an empty table gives files
without rows; extra columns are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain, filterfalse, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelens.llm import pieces as P
from treelens.llm.common import cut, ship

#: Bytes of text in a file, on average.
FILE_BYTES = 32 << 20
#: Unknown chunks that are encoded at a time.
LEARNT = 40_000
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("start_in_file", T.LongType()),
        T.StructField("file_no", T.IntegerType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)
OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_file": "false",
}


class _Symbols(dict):
    """Characters as byte-level vocabularies write them; the printable ones of ASCII stand for themselves."""

    def __missing__(self, c: int) -> str:
        self[c] = "".join(map(P.SYMBOL_OF.__getitem__, chr(c).encode()))
        return self[c]


_SYMBOLS = _Symbols({32: " "})


class Encoder:
    """Encodes texts with a word-level BPE file; chunks between spaces are remembered."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.specials = P.load(path)
        self.plain = Tokenizer(self.tok.model)  # for words that are normal and cut already
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.split = regex.compile(P.WORD_LEVEL).findall
        self.known: dict[str, bytes] = {}
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)  # tokens that end a word
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _learn(self, chunks: list[str]) -> None:
        """Encode the different words of unknown chunks as one text; the ends of words tell them apart."""
        split, known = self.split, self.known
        alone = list(filter(str.isalpha, chunks))
        others = list(filterfalse(str.isalpha, chunks))
        cut = list(map(split, others))
        # a word that was a chunk has the same ids in another chunk
        inside = set(chain.from_iterable(cut))
        words = list(inside.union(alone).difference(known))
        joined = self.plain.encode_batch_fast([" ".join(words).translate(_SYMBOLS)], add_special_tokens=False)[0]
        ids = np.array(joined.ids, "<i4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            for c in chunks:
                own = self.tok.encode(c, add_special_tokens=False).ids
                known[c] = np.array(own, "<i4").tobytes()
            return
        data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        coded = dict(zip(words, map(data.__getitem__, map(slice, cuts, cuts[1:]))))
        met = list(filter(known.__contains__, inside))
        coded.update(zip(met, map(known.__getitem__, met)))
        known.update(zip(alone, map(coded.__getitem__, alone)))
        known.update(zip(others, map(b"".join, map(partial(map, coded.__getitem__), cut))))

    def _coded(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks of common characters, in lower case."""
        new = list(filterfalse(self.known.__contains__, chunks))
        if new and len(self.known) + len(new) > P.CACHE_ENTRIES:  # those met first are the most frequent
            self.known = dict(islice(self.known.items(), P.CACHE_ENTRIES // 4))
            new = list(filterfalse(self.known.__contains__, chunks))
        for i in range(0, len(new), LEARNT):
            self._learn(new[i : i + LEARNT])
        return list(map(self.known.__getitem__, chunks))

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers; no word reaches across white space."""
        if not P.common(text, self.specials):
            ids = self.tok.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<i4").tobytes()
        chunks = text.lower().split()
        new = list(set(chunks))
        return b"".join(map(dict(zip(new, self._coded(new))).__getitem__, chunks))

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each), ``end_id`` after each text."""
        listed = [t.as_py() or "" for t in texts]
        own = {i: self(t) for i, t in enumerate(listed) if not P.common(t, self.specials)}
        plain = pa.array(["" if i in own else t.lower() for i, t in enumerate(listed)], pa.large_string())
        chunks = pc.ascii_split_whitespace(plain)
        distinct = chunks.flatten().dictionary_encode()
        coded = self._coded(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())
        # after the chunks' ids: the end's, then those of whole texts
        coded = [*coded, np.array([end_id], "<i4").tobytes(), *own.values()]
        m, lengths = len(distinct.dictionary), np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        starts = np.cumsum(lengths) - lengths
        cuts = np.cumsum(pc.list_value_length(chunks).to_numpy())
        at = np.insert(distinct.indices.to_numpy().astype(np.int64), cuts, m)
        ends = cuts + np.arange(len(listed))
        for place, i in enumerate(own):  # such a text has one empty chunk at most
            begin = ends[i - 1] + 1 if i else 0
            assert ends[i] - begin <= 1
            own[i] = (begin, ends[i], m + 1 + place)
        if own:
            begin, end, place = map(np.array, zip(*own.values()))
            at[begin[begin < end]] = place[begin < end]
            missing = begin == end
            at = np.insert(at, end[missing], place[missing])
            ends = ends + np.cumsum(np.bincount(np.array(list(own))[missing], minlength=len(listed)).astype(np.int64))
        after = np.cumsum(lengths[at])
        offsets = np.append(starts, starts[-1] + lengths[-1]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
        return lists.take(pa.array(at)).values.to_numpy(), np.diff(after[ends], prepend=0)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file, so that tasks share what it learned."""
    return Encoder(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode = encoder(path).encode_all
    file_no, start = TaskContext.get().partitionId(), 0
    for batch in batches:
        for first in range(0, batch.num_rows, 1000):
            part = batch.slice(first, 1000)
            ids, sizes = encode(part.column("text"), end_id)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(sizes), pa.array(start + offsets[:-1]),
                    pa.array(np.full(len(sizes), file_no, np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                ],
                SCHEMA.fieldNames(),
            )
            start += int(offsets[-1])


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id",
    text: str = "text", file_bytes: int = FILE_BYTES, by: list[Column] | None = None,
) -> None:
    """Encode all texts and write the files below ``path``, in ascending order of ``by`` or of ids."""
    ship(docs.sparkSession)
    given = by or []
    own = [f"by_{i}" for i in range(len(given))]
    narrow = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
        *(c.alias(name) for c, name in zip(given, own)),
    )
    total = narrow.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    order = [F.col(name) for name in own] or [F.col("doc_id"), F.xxhash64("text")]
    files = max(1, -(-total // file_bytes))
    ordered = narrow.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    coded = ordered.mapInArrow(partial(_encode, path=tokenizer, end_id=end_id), SCHEMA)
    coded.write.options(**OPTIONS).parquet(path)


def written_order(docs: DataFrame) -> list[Column]:
    """Columns that sort the rows of Parquet files of one sorted frame as they were written.

    Spark numbers part files by the sorted partitions, but reads them in any order.
    """
    of = docs.metadataColumn("_metadata")
    part = F.regexp_extract(of["file_name"], r"^part-(\d+)", 1)
    return [part.try_cast("long"), of["file_name"], of["row_index"]]


def read_tokens(spark, path: str) -> DataFrame:
    """The rows of the files, all columns; what is not selected is not read."""
    return spark.read.schema(SCHEMA).parquet(path)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy().astype("<u4", copy=False)
        view = memoryview(np.ascontiguousarray(values)).cast("B")
        crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
        keep = [batch.column(c) for c in ("doc_id", "n_tokens", "start_in_file", "file_no")]
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array(crcs, pa.int64())],
            ["doc_id", "n_tokens", "start_in_file", "file_no", "ids_crc32"],
        )


def digest(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files below ``path``.

    A document's start is its file's start plus its start in the file; only
    the file totals (a row per file) are summed in order.
    """
    ship(spark)
    stored = read_tokens(spark, path)
    sums = stored.mapInArrow(
        _sums, "doc_id long, n_tokens long, start_in_file long, file_no int, ids_crc32 long"
    )
    totals = stored.groupBy(F.col("file_no").alias("f")).agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("f")) - F.col("n")
    starts = cut(totals.select("f", before.alias("before")))
    return sums.join(starts, F.col("file_no") == F.col("f")).select(
        "doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_with_starts(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files below ``path``."""
    stored = read_tokens(spark, path)
    totals = stored.groupBy(F.col("file_no").alias("f")).agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("f")) - F.col("n")
    starts = cut(totals.select("f", before.alias("before")))
    return stored.join(starts, F.col("file_no") == F.col("f")).select(
        "doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids"
    )
