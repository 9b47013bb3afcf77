"""Language-model scoring with a probabilistic suffix tree over words.

Runs of up to ``depth`` + 1 words are counted over all training texts. Contexts of one to
``depth`` words that occur at least ``LEAST`` times are candidates; a candidate becomes
a state if its next-word distribution diverges from its suffix's by at least ``KL`` nats
(a longer state makes its suffix a state too). A state stores the next words seen at least
``LEAST`` times; the rest of its mass goes to its suffix's distribution, as does a
smoothing mass of ``KAPPA``:

    P(w | s) = (n(s, w) + (N(s) - stored(s) + KAPPA) P(w | suffix of s)) / (N(s) + KAPPA)

down to add-one word frequencies. Every word of depth costs a pass over the texts and a table. Texts are scored word by word from the longest
state that ends at the word, and one end symbol per text.

The thresholds are counts, so the model grows with the corpus; it is a distributed table.
Most pairs of words occur once, so pairs are counted in two steps: tasks hand on sorted,
delta-coded hashes of 39 bits, from which a bitmap of what may occur ``LEAST`` times is
made; exact counts follow for those. Longer runs are counted if their parts occur often
enough. Runs go to ranges of keys sorted and packed, many to a row: to the range of the run without its first
word, where they are summed and meet its probability, then to the range of their context, where they meet its total.
From there each kind of packed rows has a folder: weights, what longer runs ask for, and what may yet become a state.

A text's score is a sum over its runs: a word adds its log frequency and, as a state, the
weight of falling back; a longer run adds what it corrects. So the texts ask the table:
what a batch of texts asks is sorted, delta-coded and sent to the range of keys it lies in; the
range answers with sums per text, which meet again in the batch. Two things are broadcast and
bounded, and change no result: the weights of words with a share of ``P_WORD`` and runs with
a share of ``P_ENTRY`` at least, which all texts ask for, and bitmaps of the keys in a table,
which tell runs that need no look-up. Words and runs are told apart by 64-bit hashes.

Defined results: a null or empty text is its end symbol; repeated rows count and
are scored row by row; without training texts all counts are 0 and scores use the
smoothing alone; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.llm import shingles as S
from treelens.llm.bitmaps import PART, Bitmap, has, joined, part_rows, parts_of
from treelens.llm.coded import code, decode, pack, range_bounds, unpack
from treelens.llm.common import Tables, free, ship

P_WORD, P_ENTRY = 1e-6, 1e-6
LEAST, DEPTH = 2, 2
KL, KAPPA = 0.02, 10.0
FOLDS, HELD_OUT = 7, 2
END = np.uint64(0x5851F42D4C957F2D)
#: Distinct keys a task gathers before it hands them on.
FLUSH = 400_000
#: Rows of a batch that goes to the JVM, which holds a batch outside its heap.
SENT_ROWS = 1 << 16
#: Slices of the contexts of a depth that are counted and joined one after the other; a power of two.
#: There are more longer runs: their contexts are in ``DEEPER`` times as many.
SLICES, DEEPER = 1, 2
#: Slices of the texts that are scored one after the other, so that only a slice's questions are on disk at a time.
TEXT_SLICES = 2
#: Bits of a hash in the first count of pairs, and keys in a range of hashes, on average.
SKETCH_BITS, RANGE_KEYS = 39, 4_000_000
#: Look-ups and texts of a batch that asks the table, at most; a longer text is a batch of its own.
ASKED, ASKING = 1_000_000, 20_000

U = np.uint64


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def _longer(shorter: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of runs that are longer by a word at their end."""
    return S.mix(shorter * U(0x9FB21C651E98DF25) + words)


def _runs(batch: pa.RecordBatch, longest: int) -> Iterator[tuple]:
    """(first row, tokens of each text, text of each token, keys of runs of 1 to ``longest`` tokens).

    Keys of k tokens are listed by their first token; runs across texts are to be left out.
    """
    for first, data, offsets in S.pieces(batch.column("text")):
        hashes, counts = S.word_keys(data, offsets)
        sizes = counts + 1
        ends = np.zeros(int(sizes.sum()), dtype=bool)
        ends[np.cumsum(sizes) - 1] = True
        one = np.full(len(ends), END)
        one[~ends] = hashes
        keys = [one]
        for k in range(1, longest):
            keys.append(_longer(keys[-1][: max(0, len(one) - k)], one[k:]))
        yield first, sizes, np.repeat(np.arange(len(sizes)), sizes), keys


def _inside(text: np.ndarray, k: int) -> np.ndarray:
    """Which runs of ``k`` + 1 tokens lie in one text."""
    return text[k:] == text[: max(0, len(text) - k)]


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often they occur."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(first, append=len(keys))


def _merged(parts: list[tuple]) -> tuple:
    """Rows of equal first columns as one, with the last columns' sum; the first column tells the others but the last."""
    columns = [np.concatenate(c) for c in zip(*parts)] if len(parts) > 1 else parts[0]
    order = np.argsort(columns[0])
    keys = columns[0][order]
    first = np.flatnonzero(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]]))
    total = np.add.reduceat(columns[-1][order], first) if len(first) else np.zeros(0, np.int64)
    at = order[first]
    return (keys[first], *(c[at] for c in columns[1:-1]), total)


def _gathered(parts: Iterator[tuple]) -> Iterator[tuple]:
    """The parts, which are merged each, as few; handed on whenever many distinct keys are held."""
    kept: list[tuple] = []
    held = 0
    for part in parts:
        kept.append(part)
        held += len(kept[-1][0])
        if held > 4 * FLUSH:
            kept = [_merged(kept)]
            held = len(kept[0][0])
            if held > 2 * FLUSH:
                yield kept[0]
                kept, held = [], 0
    if held:
        yield _merged(kept)


def _batches(columns: tuple, names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype.kind == "u" else c) for c in columns], names)
    for first in range(0, whole.num_rows, SENT_ROWS):
        yield whole.slice(first, SENT_ROWS)


# packed rows -----------------------------------------------------------------------------------

#: Kinds of rows that go to a range of keys: what is looked up, what looks, then what only passes.
LOOK, RUN = 0, 1
WEIGHT, ASK, OWN = 0, 1, 2
#: Weights of a large share, bits of the bitmap of longer runs, suffixes of states, runs whose contexts do not diverge.
HOT, BIT, SUFFIX, OTHER = 3, 4, 5, 6
#: What longer runs ask for: probabilities, totals by slices of the contexts, bits of all keys.
KNOWN, TOTAL, KNOWN_BIT = 7, 8, 9
PACKED = "range int, kind int, batch long, blob binary"


def _packed(kind: int, ranges: int, columns: tuple | list, batch: int | None = None) -> pa.RecordBatch:
    """Rows of 64-bit values by the range that their first lies in."""
    order = np.argsort(columns[0].view(U))
    columns = [c[order] for c in columns]
    cuts = [0, *np.searchsorted(columns[0].view(U), range_bounds(ranges)).tolist(), len(order)]
    some = [i for i in range(ranges) if cuts[i] < cuts[i + 1]]
    blobs = [pack(*(c[cuts[i] : cuts[i + 1]] for c in columns)) for i in some]
    return _blobs(some, [kind] * len(some), [batch] * len(some), blobs)


def _blobs(ranges: list, kinds: list, batches: list, blobs: list) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    columns = [pa.array(c, t) for c, t in zip((ranges, kinds, batches, blobs), types)]
    return pa.RecordBatch.from_arrays(columns, ["range", "kind", "batch", "blob"])


def _in_bulk(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of many rows."""
    held, n = [], 0
    for b in batches:
        held.append([c.to_numpy() for c in b.columns])
        n += b.num_rows
        if n > ASKED:
            whole = [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
            yield whole
    if n:
        whole = [np.concatenate(c) for c in zip(*held)]
        held.clear()
        yield whole


def _send(batches: Iterator[pa.RecordBatch], kind: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """All columns of a table, packed."""
    for columns in _in_bulk(batches):
        yield _packed(kind, ranges, columns)


def _sent(table: DataFrame, kind: int, ranges: int) -> DataFrame:
    return table.mapInArrow(partial(_send, kind=kind, ranges=ranges), PACKED)


def _of(tables: list[DataFrame], kind: int, to: int, *more) -> DataFrame:
    """Packed rows of a kind, as rows of another."""
    table = _union(tables).filter(F.col("kind") == kind)
    for condition in more:
        table = table.filter(condition)
    return table.select("range", F.lit(to).alias("kind"), "batch", "blob")


def _by_range(sent: DataFrame, ranges: int) -> DataFrame:
    return sent.repartitionById(ranges, "range").sortWithinPartitions("range", "kind")


def _met(batches: Iterator[pa.RecordBatch], looked: int, looking: int) -> Iterator[tuple[list, list]]:
    """Columns of what is looked up, sorted, and of what looks, of one range after the other that has both."""
    at, parts = None, ([], [])
    for b in batches:
        for of, kind, blob in zip(b.column("range").to_pylist(), b.column("kind").to_pylist(), b.column("blob")):
            if of != at:
                if all(parts):
                    yield _whole(parts)
                at, parts = of, ([], [])
            parts[kind].append(unpack(blob.as_py(), (looked, looking)[kind]))
    if all(parts):
        yield _whole(parts)


def _whole(parts: tuple[list, list]) -> tuple[list, list]:
    table, rows = ([np.concatenate(c) for c in zip(*x)] for x in parts)
    for x in parts:
        x.clear()
    order = np.argsort(table[0])
    return [c[order] for c in table], rows


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Index:
    """Sorted keys that are found by their first bits, wherever the wanted lie."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.shift = np.append(keys, ~U(0)), U(62 - len(keys).bit_length())
        firsts = np.arange(1 << (64 - int(self.shift)), dtype=U) << self.shift
        self.starts = np.searchsorted(keys, firsts).astype(np.int32)

    def found(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.starts[wanted >> self.shift]
        there = self.keys[at]
        left = np.flatnonzero(there < wanted)
        while len(left):
            at[left] += 1
            there[left] = self.keys[at[left]]
            left = left[there[left] < wanted[left]]
        return at, (there == wanted) & (at < len(self.keys) - 1)


# counting --------------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = (_tally(r[3][0]) for b in batches for r in _runs(b, 1))
    for part in _gathered(parts):
        yield from _batches(part, ["key", "n"])


def _pairs(one: np.ndarray, text: np.ndarray, words: Bitmap) -> np.ndarray:
    """Which pairs lie in a text and have words of the bitmap only."""
    ok = has(words, one)
    return ok[1:] & ok[:-1] & _inside(text, 1)


def _sketch_pairs(batches: Iterator[pa.RecordBatch], maps, ranges: int) -> Iterator[pa.RecordBatch]:
    """Coded hashes of pairs by range; the last bit says that the pair came twice."""
    words, bounds = maps.value, range_bounds(ranges)

    def parts():
        for b in batches:
            for _, _, text, (one, two) in _runs(b, 2):
                yield _tally(two[_pairs(one, text, words)] >> U(64 - SKETCH_BITS))

    for keys, n in _gathered(parts()):
        cuts = [0, *np.searchsorted(keys, bounds >> U(64 - SKETCH_BITS)).tolist(), len(keys)]
        coded = keys << U(1) | (n > 1).astype(U)
        some = [i for i in range(ranges) if cuts[i] < cuts[i + 1]]
        blobs = [code(coded[cuts[i] : cuts[i + 1]]) for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["range", "blob"])


def _seen_twice(table: pa.Table) -> pa.Table:
    """The bits of the hashes of a range that came twice."""
    coded = np.sort(np.concatenate([decode(b) for b in table.column("blob").to_pylist()]))
    keys = coded >> U(1)
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[1:] == keys[:-1]
    keys = keys[(coded & U(1)).astype(bool) | same[:-1] | same[1:]]
    return pa.Table.from_batches([part_rows(keys << U(64 - SKETCH_BITS))])


def _pair_bitmap(train: DataFrame, words, n_tokens: int) -> Bitmap:
    """A bitmap with all pairs that occur twice; at most 2^(BITS - 6) words come to the driver."""
    ranges = max(1, -(-n_tokens // RANGE_KEYS))
    blobs = train.mapInArrow(partial(_sketch_pairs, maps=words, ranges=ranges), "range int, blob binary")
    return joined(blobs.groupBy("range").applyInArrow(_seen_twice, PART))


def _count_runs(batches: Iterator[pa.RecordBatch], maps, depth: int, part: int, slices: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Runs of ``depth`` + 1 tokens whose parts may all occur ``LEAST`` times, of a slice of contexts."""
    words, shorter = maps.value

    def parts():
        for b in batches:
            for _, _, text, keys in _runs(b, depth + 1):
                if depth == 1:
                    ok = _pairs(keys[0], text, words) & has(shorter, keys[1])
                else:
                    may = has(shorter, keys[depth - 1])
                    ok = may[1:] & may[:-1] & _inside(text, depth)
                i = np.flatnonzero(ok & (keys[depth - 1][: len(ok)] % U(slices) == part))
                yield _merged([(keys[depth][i], keys[depth - 1][i], keys[depth - 1][i + 1], np.ones(len(i), np.int64))])

    for key, ctx, low, n in _gathered(parts()):
        yield _packed(RUN, ranges, (low, key, ctx, n))


RUNS = "key long, ctx long, low long, n long, under double"


def _sum_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that occur ``LEAST`` times, with the log10 probability of their last token after the shorter context."""
    for (known, p), (low, key, ctx, n) in _met(batches, 2, 4):
        key, ctx, low, n = _merged([(key, ctx, low, n.view(np.int64))])
        at, hit = _found(known, low)
        hit &= n >= LEAST
        found = (key[hit], ctx[hit], low[hit], n[hit], p.view(float)[at[hit]])
        yield from _batches(found, [c.split()[0] for c in RUNS.split(", ")])


# the model -------------------------------------------------------------------------------------


def _valued(batches: Iterator[pa.RecordBatch], kl: float, kappa: float) -> Iterator[tuple]:
    """What runs correct, and their contexts' totals, weights of falling back, and whether they diverge.

    By range: columns of the runs, the first run of each context, and columns of the contexts.
    """
    for (known, totals, lows), (ctx, key, low, n, under) in _met(batches, 3, 5):
        order = np.lexsort((key, ctx))
        at, hit = _found(known, ctx[order])
        order, at = order[hit], at[hit]
        if not len(order):
            continue
        ctx, key, low, n, under = ctx[order], key[order], low[order], n.view(np.int64)[order], under.view(float)[order]
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
        sizes = np.diff(first, append=len(ctx))
        of = totals.view(np.int64)[at[first]]
        total, shorter = np.repeat(of, sizes), 10.0**under
        share = n / total
        stored = np.add.reduceat(n, first)
        gain = np.add.reduceat(share * (np.log(share) - under * math.log(10)), first)
        uncovered = np.maximum(1 - np.add.reduceat(shorter, first), 1e-12)
        rest = (of - stored) / of
        some = rest > 0
        gain[some] += rest[some] * (np.log(rest[some]) - np.log(uncovered[some]))
        left = of - stored + kappa
        back = np.log10(left / (of + kappa))
        p = np.log10((n + np.repeat(left, sizes) * shorter) / (total + kappa))
        value = p - under - np.repeat(back, sizes)
        yield (key, ctx, low, n, p, value), first, (of, back, lows[at[first]], gain >= kl)


def _pack_known(
    key: np.ndarray, n: np.ndarray, p: np.ndarray, low: np.ndarray, floor: float, slices: int, ranges: int,
) -> Iterator[pa.RecordBatch]:
    """What longer runs ask for of runs of the keys."""
    if not len(key):
        return
    yield _packed(KNOWN, ranges, (key, p))
    for part in range(slices):
        some = (n >= floor) & (key % U(slices) == part)
        if some.any():
            yield _packed(TOTAL, ranges, [c[some] for c in (key, n, low)], part)
    parts, blobs = parts_of(key)
    yield _blobs(parts, [KNOWN_BIT] * len(parts), [None] * len(parts), blobs)


def _weigh_words(batches: Iterator[pa.RecordBatch], total: float, pack_weights, pack_known) -> Iterator[pa.RecordBatch]:
    """Every token has the log probability of an unknown word already; a word adds the logarithm of its count + 1."""
    for key, n in _in_bulk(batches):
        key = key.view(U)
        yield from pack_weights(key, False, n, np.log10(n + 1.0), count=n)
        often = n >= LEAST
        key, n = key[often], n[often]
        yield from pack_known(key, n, np.log10((n + 1) / total), np.zeros(len(key), U))


def _weigh_runs(
    batches: Iterator[pa.RecordBatch], kl: float, kappa: float, depth: int, ranges: int, pack_weights, pack_known,
) -> Iterator[pa.RecordBatch]:
    """The weights of runs and contexts that diverge; if there are longer runs, what those ask for, and the others."""
    for (key, ctx, low, n, p, value), first, (of, back, suffix, diverges) in _valued(batches, kl, kappa):
        sizes = np.diff(first, append=len(ctx))
        state = np.repeat(diverges, sizes)
        yield from pack_weights(key[state], True, n[state], value[state])
        yield from pack_weights(ctx[first][diverges], depth > 1, of[diverges], back[diverges])
        if depth > 1 and diverges.any():
            yield _packed(SUFFIX, ranges, (np.unique(suffix[diverges]),))
        if pack_known is not None:
            yield from pack_known(key, n, p, low)
            rest = np.flatnonzero(~state)
            if len(rest):
                at = np.repeat(np.arange(len(first)), sizes)[rest]
                columns = [ctx[rest], key[rest], n[rest], value[rest], of[at], back[at], suffix[at]]
                yield _packed(OTHER, ranges, columns)


def _weigh_forced(batches: Iterator[pa.RecordBatch], depth: int, ranges: int, pack_weights) -> Iterator[pa.RecordBatch]:
    """The weights of runs and contexts that are states for the sake of longer ones."""
    for (forced,), (ctx, *columns) in _met(batches, 1, 7):
        hit = _found(forced, ctx)[1]
        if not hit.any():
            continue
        ctx, (key, n, value, of, back, suffix) = ctx[hit], (c[hit] for c in columns)
        yield from pack_weights(key, True, n.view(np.int64), value.view(float))
        ctx, first = np.unique(ctx, return_index=True)
        yield from pack_weights(ctx, depth > 1, of[first].view(np.int64), back[first].view(float))
        if depth > 1:
            yield _packed(SUFFIX, ranges, (np.unique(suffix),))


def _level(runs: DataFrame, lower: list[DataFrame], keep: Tables, part: int, value, ranges: int) -> DataFrame:
    """A slice's ``runs`` with candidate contexts, as ``value`` has them."""
    totals = _of(lower, TOTAL, LOOK, F.col("batch") == part)
    met = totals.union(_sent(runs.select("ctx", "key", "low", "n", "under"), RUN, ranges))
    out = keep(_by_range(met, ranges).mapInArrow(value, PACKED), "kind")
    free(keep.spark)
    return out


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def _pack_weights(
    key: np.ndarray, longer: bool, n: np.ndarray, value: np.ndarray, shares: tuple[float, float], ranges: int,
    count: np.ndarray | None = None,
) -> Iterator[pa.RecordBatch]:
    """What runs of the keys add to a text's score: packed, those of a large share apart, and the bits of longer runs' keys.

    A key has one or two rows; ``count`` is a word's own, in one row.
    """
    if not len(key):
        return
    columns = (key, np.zeros(len(key), np.int64) if count is None else count, value)
    hot = n >= shares[longer]
    for kind, some in ((HOT, hot), (WEIGHT, ~hot)):
        if some.any():
            yield _packed(kind, 1 if kind == HOT else ranges, [c[some] for c in columns])
    if longer:
        parts, blobs = parts_of(key)
        yield _blobs(parts, [BIT] * len(parts), [None] * len(parts), blobs)


def _forced(levels: list[list[DataFrame]], keep: Tables, ranges: int, pack_weights) -> None:
    """To each level, the states that are suffixes of longer states."""
    for depth in range(len(levels) - 1, 0, -1):
        met = _of(levels[depth], SUFFIX, LOOK).union(_of(levels[depth - 1], OTHER, RUN))
        weigh = partial(_weigh_forced, depth=depth, ranges=ranges, pack_weights=pack_weights)
        levels[depth - 1].append(keep(_by_range(met, ranges).mapInArrow(weigh, PACKED), "kind"))
        free(keep.spark)


def _bits(tables: list[DataFrame], kind: int) -> Bitmap:
    return joined(_of(tables, kind, kind).select(F.col("range").alias("part"), "blob"))


# scoring ---------------------------------------------------------------------------------------

ANSWERED = "batch long, texts binary, known binary, base binary, score binary, own binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _rows(names: list[str], types: dict, columns: dict, n: int) -> pa.RecordBatch:
    """A batch with nulls where no column is given."""
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(n, types[c]) if c not in columns
            else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], types[c])
            for c in names
        ],
        names,
    )


_TYPES = {"batch": pa.int64(), **{c: pa.binary() for c in ("texts", "own", "known", "base", "score")}}
_ANSWERED = [c.split()[0] for c in ANSWERED.split(", ")]


def _ask(batches: Iterator[pa.RecordBatch], model, depth: int, nothing: float, ranges: int) -> Iterator[pa.RecordBatch]:
    """What texts have without a look-up, and what they ask, coded by range."""
    from pyspark import TaskContext

    words, longer, (hot, base_of, score_of) = model.value
    bounds, number = range_bounds(ranges), TaskContext.get().partitionId() << 33
    own, keys, texts, asked, n_texts = [], [], [], 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        yield _packed(ASK, ranges, (np.concatenate(keys), np.concatenate(texts).astype(U)), number)
        sink = pa.BufferOutputStream()
        table = pa.Table.from_batches(own)
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        yield _blobs([number % ranges], [OWN], [number], [sink.getvalue().to_pybytes()])

    for batch in batches:
        is_held = np.array(batch.column("held_out").to_pylist(), dtype=bool)
        for first, sizes, text, runs in _runs(batch, depth + 1):
            n = len(sizes)
            if own and (asked > ASKED or n_texts + n > ASKING):
                yield from flush()
                number, own, keys, texts, asked, n_texts = number + 1, [], [], [], 0, 0
            held = is_held[first : first + n]
            known, base, score = np.zeros(n, np.int64), sizes * nothing, sizes * nothing
            for k, run in enumerate(runs):
                of = text[: len(run)]
                if k:
                    some = np.flatnonzero(_inside(text, k) & has(longer, run))
                    run, of = run[some], of[some]
                at, hit = hot.found(run)
                score += np.bincount(of[hit], weights=score_of[at[hit]], minlength=n)
                run, left = run[~hit], of[~hit]
                if not k:
                    base += np.bincount(of[hit], weights=base_of[at[hit]], minlength=n)
                    # a training text's word that is not in the bitmap occurs here only
                    here = ~held[left] & ~has(words, run)
                    met = np.bincount(left[here], minlength=n)
                    known += np.bincount(of[hit], minlength=n) + met
                    base, score = base + met * math.log10(2), score + met * math.log10(2)
                    run, left = run[~here], left[~here]
                keys.append(run)
                texts.append(left + n_texts)
                asked += len(run)
            own.append(pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, n), pa.array(held), pa.array(sizes.astype(np.int64)),
                 pa.array(known), pa.array(base), pa.array(score)],
                [c.split()[0] for c in SCORED.split(", ")],
            ))
            n_texts += n
    if own:
        yield from flush()


def _summed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (key, count, value) with one row for a key."""
    order = np.argsort(columns[0])
    key, count, value = (c[order] for c in columns)
    first = np.flatnonzero(np.concatenate([key[:1] == key[:1], key[1:] != key[:-1]]))
    if not len(first):
        return [key, count, value]
    return [key[first], np.add.reduceat(count, first), np.add.reduceat(value, first)]


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per text of what batches asked; rows come sorted by range and kind."""
    at_range, parts, table = None, [], None
    for rows in batches:
        for i in range(rows.num_rows):
            of, kind, batch, blob = (rows.column(c)[i].as_py() for c in ("range", "kind", "batch", "blob"))
            if of != at_range:
                at_range, parts, table = of, [(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0))], None
            if kind == WEIGHT:
                key, count, value = unpack(blob, 3)
                parts.append((key, count.view(np.int64), value.view(float)))
            elif kind == OWN:
                yield _rows(_ANSWERED, _TYPES, {"batch": [batch], "own": [blob]}, 1)
            else:
                if table is None:
                    table = _summed([np.concatenate(c) for c in zip(*parts)])
                    parts = []
                yield _sums(batch, *unpack(blob, 2), *table)


def _sums(batch: int, wanted: np.ndarray, texts: np.ndarray, keys: np.ndarray, counts: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    at, hit = _found(keys, wanted)
    at, texts = at[hit], texts[hit]
    texts, n = texts.astype(np.int64), counts[at]  # 0 for runs
    distinct = np.flatnonzero(np.bincount(texts))
    known, base, score = (np.bincount(texts, weights=w)[distinct] for w in (n > 0, np.log10(n + 1.0), values[at]))
    return _rows(_ANSWERED, _TYPES, {
        "batch": [batch], "texts": [distinct.astype(np.uint32).tobytes()],
        "known": [known.astype(np.uint32).tobytes()], "base": [base.tobytes()], "score": [score.tobytes()],
    }, 1)


def _together(table: pa.Table) -> pa.Table:
    """The texts of a batch with all answers."""
    rows = table.to_pylist()
    own = next(r["own"] for r in rows if r["own"] is not None)
    own = pa.ipc.open_stream(own).read_all()
    sums = {c: own.column(c).to_numpy().copy() for c in ("n_known", "base_score", "score")}
    for r in rows:
        if r["own"] is None:
            at = np.frombuffer(r["texts"], np.uint32)
            sums["n_known"][at] += np.frombuffer(r["known"], np.uint32)
            sums["base_score"][at] += np.frombuffer(r["base"])
            sums["score"][at] += np.frombuffer(r["score"])
    for c, values in sums.items():
        own = own.set_column(own.schema.get_field_index(c), c, pa.array(values))
    return own


def _asked(texts: DataFrame, weights: list[DataFrame], model, depth: int, nothing: float, ranges: int) -> DataFrame:
    asks = texts.mapInArrow(partial(_ask, model=model, depth=depth, nothing=nothing, ranges=ranges), PACKED)
    sent = _of(weights, WEIGHT, WEIGHT).union(asks)
    met = _by_range(sent, ranges).mapInArrow(_answer, ANSWERED)
    return met.groupBy("batch").applyInArrow(_together, SCORED)


def score_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kl: float = KL, kappa: float = KAPPA,
    p_word: float = P_WORD, p_context: float = 0.0, p_entry: float = P_ENTRY, depth: int = DEPTH,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    ``p_word`` and ``p_entry`` are the shares from which weights are broadcast; ``p_context`` asks
    for contexts of a larger share than ``LEAST`` occurrences; ``depth`` is the longest context.
    """
    spark = docs.sparkSession
    ship(spark)
    send, keep = spark.sparkContext.broadcast, Tables(spark, "lm")
    texts = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
        held_out(F.col(doc_id)).alias("held_out"),
    )
    train = texts.filter(~F.col("held_out")).select("text")
    summed = F.sum("n").alias("n")
    counts = keep(train.mapInArrow(_count_words, "key long, n long").groupBy("key").agg(summed))
    free(spark)
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    often = F.col("n") >= LEAST
    floor, slices = max(float(LEAST), p_context * n), [SLICES, *[SLICES * DEEPER] * (depth - 1)]
    ranges = max(spark.sparkContext.defaultParallelism, -(-n // RANGE_KEYS))
    pack_weights = partial(_pack_weights, shares=(p_word * n, p_entry * n), ranges=ranges)
    pack_known = [partial(_pack_known, floor=floor, slices=x, ranges=ranges) for x in slices]
    weigh = partial(_weigh_words, total=float(n + v + 1), pack_weights=pack_weights, pack_known=pack_known[0])
    lower, levels = [keep(counts.select("key", "n").mapInArrow(weigh, PACKED), "kind")], []
    all_words = lower[0]
    keep.drop(counts)
    words = _bits(lower, KNOWN_BIT)
    sent = send(words)
    shorter = _pair_bitmap(train, sent, n)
    sent.destroy()
    for k in range(1, depth + 1):
        maps, levelled = send((words, shorter)), []
        known = pack_known[k] if k < depth else None
        value = partial(_weigh_runs, kl=kl, kappa=kappa, depth=k, ranges=ranges, pack_weights=pack_weights, pack_known=known)
        deeper = slices[k - 1] // SLICES
        for part in (i * deeper + of for of in range(deeper) for i in range(SLICES)):  # only a slice's shuffles are on disk at a time
            count = partial(_count_runs, maps=maps, depth=k, part=part, slices=slices[k - 1], ranges=ranges)
            met = _of(lower, KNOWN, LOOK).union(train.mapInArrow(count, PACKED))
            runs = keep(_by_range(met, ranges).mapInArrow(_sum_runs, RUNS))
            free(spark)
            levelled.append(_level(runs, lower, keep, part, value, ranges))
            keep.drop(runs)
        maps.destroy()
        for table in lower:
            keep.drop_folders(table, *(f"kind={kind}" for kind in (KNOWN, TOTAL, KNOWN_BIT)))
        levels.append(levelled)
        if k < depth:
            lower = [*levelled]
            shorter = _bits(lower, KNOWN_BIT)
    nothing = -math.log10(n + v + 1)
    _forced(levels, keep, ranges, pack_weights)
    weights = [all_words, *(table for level in levels for table in level)]
    for table in weights:
        keep.drop_folders(table, f"kind={OTHER}")
    longer = _bits(weights, BIT)
    hot = _of(weights, HOT, HOT).select("blob").toArrow().column("blob").to_pylist()
    hot = [(np.zeros(0, U), np.zeros(0, U), np.zeros(0, U)), *(unpack(blob, 3) for blob in hot)]
    key, count, value = (np.concatenate(c) for c in zip(*hot))
    key, count, value = _summed([key, count.view(np.int64), value.view(float)])
    model = send((words, longer, (Index(key), np.log10(count + 1.0), value)))
    scored = []
    for part in range(TEXT_SLICES):
        mine = texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(TEXT_SLICES)) == part)
        scored.append(keep(_asked(mine, weights, model, depth, nothing, ranges)))
        free(spark)
    model.destroy()
    keep.drop_but(*scored)
    return _union(scored).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )
