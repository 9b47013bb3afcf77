"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised (lower case, runs of non-word characters become
one space). An item of n characters may occur with up to ``floor(rate * n)``
edits. Cut into one piece more than that, at least one piece must occur exactly: an
Aho-Corasick automaton finds all pieces of all items in one pass over a text, and
Myers' bit-parallel algorithm verifies the windows around the hits.

The items are the query set and all documents are searched. Their number is
checked: up to ``BLOCK_CHARS`` characters of items are sent to the workers at once,
and a larger benchmark is searched in several such blocks.

Defined results: a null or empty text has no hit; items that are null or empty
after normalising are found nowhere; repeated items are found under each id, repeated
documents row by row; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.llm.common import free_name, ship

RATE = 0.05
BLOCK_CHARS = 8_000_000
_WORDS = re.compile(r"\w+")


def normalise(text: str | None) -> str:
    return " ".join(_WORDS.findall(text.lower())) if text else ""


def masks(pattern: str) -> dict[str, int]:
    """For each character the bits of its places in the pattern."""
    out: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def least_distance(peq: dict[str, int], m: int, text: str) -> int:
    """Smallest edit distance of the pattern to any substring of ``text`` (Myers)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    get = peq.get
    for ch in text:
        eq = get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    return 0
        ph = ph << 1 & full  # a match may begin anywhere: nothing enters below
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best


def cut_item(item: str, rate: float) -> list[tuple[int, str]]:
    """(offset, piece): one piece more than the edits allowed, as even as can be."""
    parts = int(rate * len(item)) + 1
    edges = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:]) if b > a]


class Matcher:
    """The automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, self.rate = items, rate
        self.automaton = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            for offset, piece in cut_item(text, rate):
                pieces.setdefault(piece, []).append((k, offset))
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()
        self.peq: dict[int, dict[str, int]] = {}

    def hits(self, text: str) -> Iterator[tuple[int, int]]:
        """(item id, edit distance) of every item that occurs within its budget."""
        if not text or not len(self.automaton):
            return
        windows: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.automaton.iter(text):
            begin = end + 1 - length
            for k, offset in where:
                n = len(self.items[k][1])
                slack = int(self.rate * n)
                lo, hi = max(0, begin - offset - slack), begin - offset + n + slack
                spans = windows.setdefault(k, [])
                if spans and lo <= spans[-1][1]:
                    spans[-1][0] = min(lo, spans[-1][0])
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
        for k, spans in windows.items():
            item_id, item = self.items[k]
            budget = int(self.rate * len(item))
            if not budget:  # a short item: whole words only, or it would be found inside others
                if f" {item} " in f" {text} ":
                    yield item_id, 0
                continue
            if item in text:
                yield item_id, 0
                continue
            if k not in self.peq:
                self.peq[k] = masks(item)
            best = min(least_distance(self.peq[k], len(item), text[lo:hi]) for lo, hi in spans)
            if best <= budget:
                yield item_id, best


def _search(batches: Iterator[pa.RecordBatch], items, rate: float) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(items.value, rate)
    for batch in batches:
        docs, found, distances = [], [], []
        ids = batch.column("doc_id")
        for i, text in enumerate(batch.column("text")):
            for item, distance in matcher.hits(normalise(text.as_py())):
                docs.append(ids[i].as_py())
                found.append(item)
                distances.append(distance)
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(found, pa.int64()), pa.array(distances, pa.int64())],
            ["doc_id", "item_id", "distance"],
        )


def leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", rate: float = RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, distance) of every benchmark item found in a document."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).dropna()
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = []
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        block = [(r["i"], normalise(r["t"])) for r in part.collect()]  # of checked size
        sent = spark.sparkContext.broadcast([x for x in block if x[1]])
        found.append(
            narrow.mapInArrow(
                partial(_search, items=sent, rate=rate), "doc_id long, item_id long, distance long"
            )
        )
    return reduce(DataFrame.unionByName, found)


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents in which no benchmark item was found, with their own columns."""
    (leaked,) = free_name(docs, "leaked_id")
    gone = leaks(docs, benchmark, doc_id, text, **options).select(F.col("doc_id").alias(leaked)).distinct()
    return docs.join(gone, F.col(doc_id) == F.col(leaked), "left_anti")
