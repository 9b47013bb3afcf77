"""Documents that share a run of words with another document, exactly.

Beside the byte strings that suffix dedup removes, short words can make a long passage of few
bytes. A window of ``PASSAGE`` words is represented by the least hash of its ``GRAM``-word runs;
equal windows have the same one. Runs that represent windows of two places or more are told by
a bitmap; only windows with such a run are compared. Their hashes are sent sorted and
delta-coded to ranges of hashes, where those of two documents or more are found.

Words are compared without ASCII case, and by 64-bit hashes. Defined results: a null text or
one with fewer words shares nothing; rows with one id and one text are one document; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelens.llm import shingles as S
from treelens.llm.bitmaps import bitmap, has
from treelens.llm.coded import code, decode, range_bounds
from treelens.llm.common import free, ship

PASSAGE, GRAM = 50, 8
#: Windows in a range of hashes, on average, and windows a task gathers before it hands them on.
RANGE_KEYS, FLUSH = 4_000_000, 1_000_000

U = np.uint64


def document_key(doc_id: Column, text_hash: Column) -> Column:
    return F.xxhash64(doc_id, text_hash)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return S.mix(left * U(0x9FB21C651E98DF25) + right)


def _of_length(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, by doubling."""
    out, done, power, size = None, 0, words, 1
    while n:
        if n & 1:
            m = len(words) - done - size + 1
            out = power if out is None else _join(out[:m], power[done : done + m])
            done += size
        n >>= 1
        power = _join(power[: max(0, len(power) - size)], power[size:])
        size *= 2
    return out


def _windows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, text, representing run and hash) of the windows of a piece."""
    for first, data, offsets in S.pieces(batch.column("text")):
        words, counts = S.word_hashes(data, offsets)
        text = np.repeat(np.arange(len(counts)), counts)
        if len(words) < PASSAGE:
            continue
        least, reach, w = _of_length(words, GRAM), 1, PASSAGE - GRAM + 1
        while reach * 2 <= w:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < w:
            least = np.minimum(least[: len(least) - (w - reach)], least[w - reach :])
        inside = np.flatnonzero(text[: len(least)] == text[PASSAGE - 1 :])
        yield first, text[inside], least[inside], _of_length(words, PASSAGE)[inside]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The representing runs, once per stretch of windows, and the number of windows."""
    for batch in batches:
        for _, text, least, _ in _windows(batch):
            fresh = np.ones(len(least), dtype=bool)
            fresh[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
            runs, n = np.unique(least[fresh], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), pa.array(n)], ["run", "n"])


def _sent(batches: Iterator[pa.RecordBatch], maps, ranges: int) -> Iterator[pa.RecordBatch]:
    """(range, keys, documents): coded windows that may be shared, sorted by hash."""
    bounds, held, n = range_bounds(ranges), [], 0

    def flush() -> pa.RecordBatch:
        keys, docs = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
        some = [i for i in range(ranges) if cuts[i] < cuts[i + 1]]
        rows = []
        for i in some:
            own, at = np.unique(docs[cuts[i] : cuts[i + 1]], return_inverse=True)
            rows.append((i, code(keys[cuts[i] : cuts[i + 1]]), own.tobytes(), at.astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 3))], ["range", "keys", "own", "at"]
        )

    for batch in batches:
        of = batch.column("d").to_numpy()
        for first, text, least, whole in _windows(batch):
            some = has(maps.value, least)
            key, doc = whole[some], of[text[some] + first]
            if not len(key):
                continue
            order = np.lexsort((key, text[some]))  # a text sends a window once
            key, doc = key[order], doc[order]
            once = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
            held.append((key[once], doc[once]))
            n += len(held[-1][0])
            if n > FLUSH:
                yield flush()
                held, n = [], 0
    if held:
        yield flush()


def _met(table: pa.Table) -> pa.Table:
    """Documents of a range whose windows another document has."""
    keys, docs = [], []
    for r in table.to_pylist():
        keys.append(decode(r["keys"]))
        docs.append(np.frombuffer(r["own"], np.int64)[np.frombuffer(r["at"], np.uint32)])
    keys, docs = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    end = np.append(begin[1:], len(keys)) - 1
    several = np.repeat(docs[begin] != docs[end], end - begin + 1)
    return pa.table({"d": pa.array(np.unique(docs[several]))})


def sharing(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d) of the documents that share ``PASSAGE`` words in a row with another; ``d`` is the
    :func:`document_key` of the id and the text's CRC."""
    spark = docs.sparkSession
    ship(spark)
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(document_key(F.col(doc_id).cast("long"), F.crc32(whole)).alias("d"), whole.alias("text"))
    counts = texts.mapInArrow(_runs, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    often = counts.filter("n > 1")
    maps = spark.sparkContext.broadcast(bitmap(often, "run"))
    # a run represents at most so many windows, so this bounds what is sent
    most = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (PASSAGE - GRAM + 1)
    free(spark)
    ranges = max(spark.sparkContext.defaultParallelism, -(-most // RANGE_KEYS))
    sent = texts.mapInArrow(partial(_sent, maps=maps, ranges=ranges), "range int, keys binary, own binary, at binary")
    return sent.groupBy("range").applyInArrow(_met, "d long").distinct()
