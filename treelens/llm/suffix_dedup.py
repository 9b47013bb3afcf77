"""Exact removal of repeated byte strings by a distributed sparse suffix array.

A byte is removed if a string of ``WINDOW`` bytes that covers it also starts anywhere
else. Sorting every suffix would move hundreds of bytes per byte of text, so only
suffixes at anchors are sorted: the anchor of a window is the position in it whose
``GRAM`` bytes hash least (the first of several), so equal windows have the same
anchor at the same place, and every window has one.

1. Anchors are found in one pass and their leading bytes counted with partial aggregation;
   a bitmap of those that occur twice or more tells the second pass which anchors to keep.
   In a text with a short period (a run of one character, a repeated line) every window
   equals the one a period before it: such windows are known to be repeated, and only the first
   of them keeps its anchor, for other texts to meet.
2. Anchors with the same bytes all around (as far as a window can reach) are one
   context with a number of occurrences, so copies never pile up. Contexts that are alone
   with their leading bytes are settled: occurring twice or more, all is repeated.
3. The suffixes of the other contexts are range-partitioned by their leading bytes with
   sampled splitters; a partition streams through buckets that end where the leading bytes
   change. Each bucket is sorted by multikey quicksort, and neighbours are
   compared: the longest common prefix bounds which windows of a suffix can be
   repeated. Those windows are matched inside the bucket by two 64-bit hashes, bytes before
   the anchor included.
4. Suffixes that agree on their leading bytes meet in one bucket. A group
   with more contexts than a bucket holds is cut into salted buckets instead; what a bucket
   can't decide alone is compared across the buckets' boundaries by the same hashes.
5. The repeated spans go back to the anchors, then to their documents, and are cut out.

Defined results: a null text is empty; texts shorter than a window lose nothing;
repeated rows are documents of their own, so both lose what they share; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.llm import shingles as S
from treelens.llm.bitmaps import bitmap, has
from treelens.llm.common import Tables, cut, free, ship

WINDOW, GRAM = 400, 48
#: Contexts a bucket holds, contexts that make a group of its own buckets, and buckets that
#: follow each other in a partition.
BUCKET_ROWS, HOT_ROWS, BUCKETS = 1_500, 3_000, 8
#: Places around the anchor that are matched at a time.
OFFSETS = 48
#: Contexts in an Arrow batch on their way to the buckets.
FETCHED = 4_000
#: Bytes of one text that are handled at once, and bits of a place inside them.
BLOCK, PLACE_BITS = 1 << 22, 24

U = np.uint64
_SECOND = U(0xC2B2AE3D27D4EB4F)
_SECOND_INVERSE = U(pow(0xC2B2AE3D27D4EB4F, -1, 2**64))
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    t = np.full(n + 1, base, dtype=np.uint64)
    t[0] = 1
    return np.multiply.accumulate(t)


class _Rolling:
    """Hashes of any span of a byte string from prefix sums."""

    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int = 0):
        base, inverse = ((S._BASE, S._INVERSE), (_SECOND, _SECOND_INVERSE))[which]
        n = len(data)
        have = self.tables.get(which)
        if have is None or len(have[0]) <= n:
            size = max(1 << 16, 1 << n.bit_length())
            have = self.tables[which] = (_powers(base, size), _powers(inverse, size))
        self.down = have[1]
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * have[0][:n], out=self.sums[1:])

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return S.mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def _block_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted places of the anchors of the windows inside the texts of a block, and begins and ends
    of spans whose windows equal windows a short period before."""
    n, w = len(data), WINDOW - GRAM + 1
    lengths = np.diff(offsets)
    none = np.zeros(0, np.int64)
    if not (lengths >= WINDOW).any():
        return none, none, none
    grams = np.arange(n - GRAM + 1)
    roll = _Rolling(data)
    key = roll.spans(grams, grams + GRAM)
    key = (key >> U(PLACE_BITS)) << U(PLACE_BITS) | grams.astype(np.uint64)
    least, reach = key, 1
    while reach * 2 <= w:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < w:
        least = np.minimum(least[: len(least) - (w - reach)], least[w - reach :])
    first = np.zeros(n + 1, dtype=np.int32)  # windows may begin where the text has room for one
    long = lengths >= WINDOW
    np.add.at(first, offsets[:-1][long], 1)
    np.add.at(first, offsets[1:][long] - WINDOW + 1, -1)
    windows = np.flatnonzero(np.cumsum(first[: len(least)]) > 0)
    if not len(windows):
        return none, none, none
    least = least[windows]
    change = np.flatnonzero(np.diff((least & U((1 << PLACE_BITS) - 1)).astype(np.int64), prepend=-1))
    places = (least[change] & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    # an anchor that hashes like the one before it, near by: its windows may equal those a period before
    steps = np.diff(places, prepend=places[:1])
    like = (steps > 0) & (steps < w) & (np.diff(least[change] >> U(PLACE_BITS), prepend=U(0)) == 0)
    if not like.any():
        return places, none, none
    owned = np.diff(np.append(change, len(windows)))
    some = np.flatnonzero(np.repeat(like, owned))
    begin = windows[some]
    before = begin - np.repeat(steps, owned)[some]
    inside = before >= offsets[np.searchsorted(offsets, begin, "right") - 1]
    some, begin, before = some[inside], begin[inside], before[inside]
    for r in (roll, _Rolling(data, 1)):
        same = r.spans(begin, begin + WINDOW) == r.spans(before, before + WINDOW)
        some, begin, before = some[same], begin[same], before[same]
    if not len(some):
        return places, none, none
    own = np.ones(len(windows), dtype=np.int64)
    own[some] = 0
    places = places[np.add.reduceat(own, change) > 0]
    order = np.argsort(before, kind="stable")
    begin, end = before[order], np.maximum.accumulate(begin[order] + WINDOW)
    fresh = np.flatnonzero(np.concatenate([[True], begin[1:] >= end[:-1]]))
    return places, begin[fresh], end[np.append(fresh[1:] - 1, len(end) - 1)]


def _context_rows(data, offsets, maps=None):
    """(text index, place, gram hash, context hash) of the anchors of a piece, and (text index,
    begin, end) of the spans that are repeated with a short period."""
    anchors, spans = [], []
    if len(data) <= 2 * BLOCK:
        blocks = [(data, offsets, 0, 0, 0)]
    else:  # one long text, cut into overlapping blocks with room for the contexts
        n, margin = len(data), WINDOW
        blocks = []
        for s in range(0, max(1, n - WINDOW + 1), BLOCK):
            lo, hi = max(0, s - margin), min(n, s + BLOCK + 2 * WINDOW)
            blocks.append((data[lo:hi], np.array([0, hi - lo]), lo, s, min(n, s + BLOCK + WINDOW - 1)))
    seen = -1
    for part, offs, lo, s, e in blocks:
        if len(blocks) > 1:
            places, begin, end = (x + (s - lo) for x in _block_anchors(part[s - lo : e - lo], np.array([0, e - s])))
            places = places[places + lo > seen]
            if len(places):
                seen = int(places[-1]) + lo
        else:
            places, begin, end = _block_anchors(part, offs)
        text = np.searchsorted(offs, begin, "right") - 1
        spans.append((text, begin - offs[text] + lo, end - offs[text] + lo))
        if not len(places):
            continue
        roll = _Rolling(part)
        gram = roll.spans(places, places + GRAM)
        if maps is not None:
            kept = has(maps, gram)
            places, gram = places[kept], gram[kept]
        text = np.searchsorted(offs, places, "right") - 1
        begin = np.maximum(offs[text], places - (WINDOW - GRAM))
        end = np.minimum(offs[text + 1], places + WINDOW)
        shape = ((places - begin) * 1024 + (end - places)).astype(np.uint64)
        around = S.mix(roll.spans(begin, end) + shape * _SECOND)
        anchors.append((text, places - offs[text] + lo, gram, around))
    return anchors, spans


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leading bytes of all anchors, hashed, with their number in a piece."""
    for batch in batches:
        for _, data, offsets in S.pieces(batch.column("text")):
            for _, _, gram, _ in _context_rows(data, offsets)[0]:
                distinct, n = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(n)], ["gram", "n"])


def _anchors(batches: Iterator[pa.RecordBatch], maps) -> Iterator[pa.RecordBatch]:
    """Anchors whose leading bytes may occur twice; spans known to be repeated have no gram, and
    their length instead of a context."""
    for batch in batches:
        for first, data, offsets in S.pieces(batch.column("text")):
            anchors, spans = _context_rows(data, offsets, maps.value)
            rows = [(text, place, pa.array(gram.view(np.int64)), around.view(np.int64)) for text, place, gram, around in anchors]
            rows += [(text, begin, pa.nulls(len(text), pa.int64()), end - begin) for text, begin, end in spans]
            for text, place, gram, around in rows:
                of = pa.array(text + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(of), batch.column("th").take(of),
                        pa.array(place.astype(np.int32)), gram, pa.array(around.astype(np.int64)),
                    ],
                    ["doc_id", "th", "place", "gram", "around"],
                )


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the wanted anchors of each text."""
    for batch in batches:
        out = {k: [] for k in ("gram", "around", "n", "hot", "suffix", "before")}
        for text, wanted in zip(batch.column("text"), batch.column("wanted")):
            data = memoryview(text.as_buffer()) if text.is_valid else b""
            for w in wanted.as_py():
                if len(out["n"]) >= FETCHED:
                    yield _fetched(out)
                    for column in out.values():
                        column.clear()
                p = w["place"]
                out["gram"].append(w["gram"])
                out["around"].append(w["around"])
                out["n"].append(w["n"])
                out["hot"].append(w["hot"])
                out["suffix"].append(bytes(data[p : p + WINDOW]))
                out["before"].append(bytes(data[max(0, p - WINDOW + GRAM) : p]))
        yield _fetched(out)


def _fetched(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(out["gram"], pa.int64()), pa.array(out["around"], pa.int64()),
         pa.array(out["n"], pa.int64()), pa.array(out["hot"], pa.bool_()), pa.array(out["suffix"], pa.binary()),
         pa.array(out["before"], pa.binary())],
        list(out),
    )


def multikey_quicksort(strings: list[bytes]) -> np.ndarray:
    """Order of the strings; three-way partitioning, eight bytes at a time."""
    n = len(strings)
    depth = -(-max(map(len, strings), default=0) // 8) or 1
    padded = b"".join(s.ljust(8 * depth, b"\0") for s in strings)
    keys = np.frombuffer(padded, dtype=">u8").reshape(n, depth).astype(np.uint64)
    order = np.arange(n)
    todo = [(0, n, 0)]
    while todo:
        lo, hi, d = todo.pop()
        if hi - lo < 2:
            continue
        part = order[lo:hi]
        if hi - lo <= 16 or d == depth:
            order[lo:hi] = sorted(part.tolist(), key=strings.__getitem__)
            continue
        column = keys[part, d]
        pivot = np.median(column[[0, (hi - lo) // 2, -1]].astype(np.float64))
        pivot = column[np.argmin(np.abs(column.astype(np.float64) - pivot))]
        less, same = column < pivot, column == pivot
        more = ~(less | same)
        order[lo:hi] = np.concatenate([part[less], part[same], part[more]])
        a = lo + int(less.sum())
        b = a + int(same.sum())
        todo += [(lo, a, d), (a, b, d + 1), (b, hi, d)]
    return order


def _neighbour_prefix(strings: list[bytes]) -> np.ndarray:
    """Longest common prefix of each string with the next, in sorted order."""
    width = max(map(len, strings), default=0)
    rows = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
    differs = rows[:-1] != rows[1:]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width) if width else np.zeros(len(rows) - 1, int)
    lengths = np.array([len(s) for s in strings])
    return np.minimum(common, np.minimum(lengths[:-1], lengths[1:]))


def _spans(starts: np.ndarray, before: int) -> list[dict[str, int]]:
    """Union of windows as spans around the anchor."""
    cuts = np.flatnonzero(np.diff(starts) > WINDOW)
    begin = starts[np.concatenate([[0], cuts + 1])]
    end = starts[np.concatenate([cuts, [len(starts) - 1]])] + WINDOW
    return [{"s": int(b) - before, "e": int(e) - before} for b, e in zip(begin, end)]


def _resolve(bucket: pd.DataFrame, across: bool) -> pd.DataFrame:
    """Sort a bucket's suffixes and find the repeated windows of every context."""
    suffixes = list(bucket["suffix"])
    order = multikey_quicksort(suffixes)
    suffixes = [suffixes[i] for i in order]
    grams, arounds = bucket["gram"].to_numpy()[order], bucket["around"].to_numpy()[order]
    counts, befores = bucket["n"].to_numpy()[order], [bucket["before"].iat[i] for i in order]
    shared = np.zeros(len(order) + 1, dtype=np.int64)
    shared[1:-1] = _neighbour_prefix(suffixes)
    longest = np.maximum(shared[:-1], shared[1:])
    if across:  # a neighbour may be in another bucket
        longest[:] = WINDOW
    left = np.array([len(b) for b in befores])
    lengths = left + np.array([len(s) for s in suffixes])
    data = np.frombuffer(b"".join(x for pair in zip(befores, suffixes) for x in pair), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    # window p of a context covers the anchor's gram and reaches p + WINDOW - left into the suffix
    room = np.maximum(lengths - WINDOW + 1, 0)
    reach = np.where(counts > 1, room, np.minimum(room, np.maximum(left + longest - WINDOW + 1, 0)))
    n, width = len(order), WINDOW - GRAM + 1
    hit, leader = np.zeros((n, width), dtype=bool), np.zeros((n, width), dtype=bool)
    hashes = np.zeros((2, n, width), dtype=np.uint64) if across else None
    rolls = [_Rolling(data, which) for which in (0, 1)]
    # equal windows lie at one place around their anchors, so places go block by block
    for place in range(0, width, OFFSETS):
        low = np.maximum(left - (place + OFFSETS - 1), 0)
        some = np.maximum(np.minimum(left - place + 1, reach) - low, 0)
        owner = np.repeat(np.arange(n), some)
        if not len(owner):
            continue
        local = np.arange(len(owner)) - np.repeat(np.cumsum(some) - some, some) + low[owner]
        begin = offsets[owner] + local
        one, two = (r.spans(begin, begin + WINDOW) for r in rolls)
        # neighbouring anchors of one text show the same window, at another place
        one = S.mix(one + grams[owner].view(np.uint64) + (left[owner] - local).astype(np.uint64) * _SECOND)
        rank = np.lexsort((two, one))
        same = np.zeros(len(rank) + 1, dtype=bool)
        same[1:-1] = (one[rank][1:] == one[rank][:-1]) & (two[rank][1:] == two[rank][:-1])
        repeated, first = np.zeros(len(rank), dtype=bool), np.zeros(len(rank), dtype=bool)
        repeated[rank] = same[:-1] | same[1:]
        first[rank] = ~same[:-1]  # one window of each string speaks for it
        hit[owner, local] = repeated | (counts[owner] > 1)
        leader[owner, local] = first
        if across:
            hashes[0, owner, local], hashes[1, owner, local] = one, two
    rows = []
    for i in range(n):
        found = np.flatnonzero(hit[i, : reach[i]])
        spans = _spans(found, int(left[i])) if len(found) else []
        more = ([], [])
        if across:
            rest = np.flatnonzero(~hit[i, : reach[i]])
            known = np.flatnonzero(hit[i, : reach[i]] & leader[i, : reach[i]])
            mine = hashes[:, i].view(np.int64)
            more = tuple(
                [{"h": int(h), "g": int(g), "p": int(p)} for h, g, p in zip(*mine[:, at], at)] for at in (rest, known)
            )
        rows.append((int(grams[i]), int(arounds[i]), spans, int(left[i]), *more))
    return pd.DataFrame(rows, columns=["gram", "around", "spans", "left", "open", "known"])


FOUND = "gram long, around long, n long, hot boolean"
RESOLVED = (
    "gram long, around long, spans array<struct<s: int, e: int>>, left int, "
    "open array<struct<h: long, g: long, p: int>>, known array<struct<h: long, g: long, p: int>>"
)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for text, hits in zip(batch.column("text"), batch.column("hits")):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            spans = sorted(
                (max(0, h["place"] + h["s"]), min(len(data), h["place"] + h["e"])) for h in (hits.as_py() or [])
            )
            kept, at, runs, removed = [], 0, 0, 0
            for s, e in spans:
                if e <= at:
                    continue
                if s > at or not runs:
                    kept.append(data[at:s])
                    runs += 1
                    at = s
                removed += e - at
                at = e
            kept.append(data[at:])
            rest = b"".join(kept)
            for k, v in zip(out, (len(data), removed, runs, hashlib.sha256(rest).hexdigest(), rest)):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
             pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string()),
             pa.array(out["kept"], pa.binary()), batch.column("th")],
            ["doc_id", *out, "th"],
        )


def _contexts(survivors: DataFrame, texts: DataFrame, few: int) -> tuple[DataFrame, DataFrame]:
    """(settled contexts, contexts with bytes); ``few`` is the size of a hot group."""
    groups = survivors.filter("gram IS NOT NULL").groupBy("gram", "around").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "place")).alias("at")
    )
    groups = cut(groups)
    sizes = groups.groupBy(F.col("gram").alias("g")).agg(F.count(F.lit(1)).alias("variants"))
    groups = cut(groups.join(sizes, F.col("gram") == F.col("g")).drop("g"))
    settled = groups.filter("variants = 1 AND n > 1").select("gram", "around")
    open_ = groups.filter("variants > 1")
    wanted = open_.select(
        "at.doc_id", "at.th", F.struct("at.place", "gram", "around", "n", (F.col("variants") > few).alias("hot")).alias("w")
    )
    wanted = wanted.groupBy("doc_id", "th").agg(F.collect_list("w").alias("wanted"))
    distinct = texts.join(wanted, _same_text(texts, wanted)).select(texts["text"], "wanted")
    rows = distinct.mapInArrow(_fetch, f"{FOUND}, suffix binary, before binary")
    # equal rows fetch the same context more than once
    rows = rows.groupBy("gram", "around").agg(
        *(F.max(c).alias(c) for c in ("n", "hot", "suffix", "before"))
    )
    return settled, cut(rows)


def _same_text(texts: DataFrame, other: DataFrame):
    return texts["doc_id"].eqNullSafe(other["doc_id"]) & (texts["th"] == other["th"])


def _in_buckets(batches: Iterator[pa.RecordBatch], bucket_rows: int) -> Iterator[pa.RecordBatch]:
    """Resolve a partition that is sorted by leading bytes, bucket by bucket."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        heads = batch.column("head")
        begin = 0
        for i in range(batch.num_rows):
            if n + i - begin >= bucket_rows and heads[i] != (heads[i - 1] if i else last):
                yield _resolved([*held, batch.slice(begin, i - begin)])
                held, n, begin = [], 0, i
        if batch.num_rows:
            held.append(batch.slice(begin))
            n, last = n + batch.num_rows - begin, heads[batch.num_rows - 1]
    if n:
        yield _resolved(held)


def _resolved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    out = _resolve(pa.Table.from_batches(held).to_pandas(), across=False)
    spans = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(out["gram"], pa.int64()), pa.array(out["around"], pa.int64()), pa.array(list(out["spans"]), spans)],
        ["gram", "around", "spans"],
    )


def _repeated_spans(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """(gram, around, spans) of the contexts with repeated windows."""
    cold = rows.filter("NOT hot").select(F.substring("suffix", 1, GRAM).alias("head"), "gram", "around", "n", "suffix", "before")
    partitions = max(1, -(-rows.count() // (bucket_rows * BUCKETS)))
    cold = cold.repartitionByRange(partitions, "head").sortWithinPartitions("head")
    out = cold.mapInArrow(partial(_in_buckets, bucket_rows=bucket_rows), "gram long, around long, spans array<struct<s: int, e: int>>")
    hot = rows.filter("hot")
    if hot.isEmpty():
        return out
    # groups beyond a bucket: salted buckets, then a comparison across them
    salts = max(2, -(-hot.count() // bucket_rows))
    salted = hot.withColumn("bucket", F.pmod("around", F.lit(salts)))
    salted = salted.select("gram", "around", "n", "suffix", "before", "bucket")
    parts = cut(salted.groupBy("bucket").applyInPandas(partial(_resolve, across=True), RESOLVED))
    undecided = parts.select("gram", "around", "left", F.explode("open").alias("w")).select(
        "gram", "around", "left", "w.h", "w.g", "w.p"
    )
    seen = undecided.select("h", "g").unionByName(parts.select(F.explode("known").alias("w")).select("w.h", "w.g"))
    twice = seen.groupBy("h", "g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h", "g")
    late = undecided.join(twice, ["h", "g"]).select(
        "gram", "around",
        F.array(F.struct((F.col("p") - F.col("left")).alias("s"), (F.col("p") - F.col("left") + WINDOW).alias("e"))).alias("spans"),
    )
    late = late.groupBy("gram", "around").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return out.unionByName(parts.select("gram", "around", "spans")).unionByName(late)


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, th) of every document;
    ``kept`` holds the remaining bytes, ``th`` is the CRC of the text."""
    ship(docs.sparkSession)
    texts = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("th", F.crc32("text"))
    often = texts.mapInArrow(_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1")
    maps = docs.sparkSession.sparkContext.broadcast(bitmap(often, "gram"))
    anchors = texts.mapInArrow(partial(_anchors, maps=maps), "doc_id long, th long, place int, gram long, around long")
    keep = Tables(docs.sparkSession, "spans")
    survivors = keep(anchors)
    maps.destroy()
    free(docs.sparkSession)
    settled, rows = _contexts(survivors, texts, hot_rows)
    free(docs.sparkSession)
    whole = F.array(F.struct(F.lit(-(WINDOW - GRAM)).alias("s"), F.lit(WINDOW).alias("e")))
    spans = settled.withColumn("spans", whole).unionByName(
        _repeated_spans(rows, bucket_rows).filter(F.size("spans") > 0)
    )
    spans = keep(spans.select(F.col("gram").alias("g"), F.col("around").alias("a"), "spans"))
    del rows, settled  # their checkpoints go with them
    free(docs.sparkSession)
    hits = survivors.join(spans, (F.col("gram") == F.col("g")) & (F.col("around") == F.col("a")))
    hits = hits.select("doc_id", "th", "place", F.explode("spans").alias("x")).select(
        "doc_id", "th", F.struct("place", "x.s", "x.e").alias("hit")
    )
    known = survivors.filter("gram IS NULL").select(
        "doc_id", "th", F.struct("place", F.lit(0).alias("s"), F.col("around").cast("int").alias("e")).alias("hit")
    )
    hits = hits.unionByName(known)
    hits = hits.groupBy("doc_id", "th").agg(F.collect_set("hit").alias("hits"))
    both = texts.join(hits, _same_text(texts, hits), "left").select(texts["doc_id"], texts["th"], "text", "hits")
    return both.mapInArrow(
        _cut_out,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, th long",
    )
