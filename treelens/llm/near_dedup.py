"""Near-duplicate components by circulant MinHash, banding and exact verification.

Two permutations make the whole signature: the first maps a shingle hash to a
32-bit position, the second is shifted circularly by k for the k-th coordinate.
Bands of the signature are bucket keys. Texts with one shingle set are one
representative from then on, so groups of copies never grow a bucket.

Links are looked for star by star, a few bands at first, then the others, of which only buckets
with members of several components are left. Every bucket has a hub; each member of another
component is verified against it on the full sets. Buckets whose members are then in one
component are done. In the others, all members outside the bucket's largest component look
for partners among all its members: the full sets meet in a group, where each set is
a row of bits over the elements that members share, so that intersections are exact
counts of bits. A group hands on the links that join its components, a spanning forest, not all pairs. Large
buckets are cut into blocks of those who look and of those who are looked for, and every two
blocks meet in a group of bounded size. Buckets with the same members are looked at once.
Nothing is capped, and no link between two components is lost. What banding
can miss has a probability below ``(1 - t^rows)^bands`` per link: 3e-7 at the
threshold for 5 rows and 26 bands.

Defined results: null and blank texts have the empty set, size 0, and are a
component of their own; repeated rows each get a row; rows that share an id are one
document, whatever their texts; rows with a null id are components of
their own and kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.llm import shingles as S
from treelens.llm.bitmaps import bitmap, has
from treelens.llm.common import cut, free, free_name, ship
from treelens.llm.components import components

WIDTH, PERCENT, BANDS, ROWS = 5, 85, 26, 5
#: Members that look for partners, and members looked for, in a group, at most; and their elements.
NESTED_HUBS, GROUP_ELEMENTS = 1024, 1 << 19
#: Bands that are looked at first: they join most copies, so the others have few buckets left.
FIRST_BANDS = 6
#: Elements of a chunk for which the permutations are evaluated at a time.
CHUNK = 1 << 15


def _permuted(x: np.ndarray) -> np.ndarray:
    """The second permutation of the 32-bit positions, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """(texts x coordinates) circulant MinHash values; rows of empty sets are 0."""
    out = np.zeros((len(sizes), coordinates), dtype=np.uint32)
    places = (sets >> np.uint64(32)).astype(np.uint32)  # the first permutation
    full = np.flatnonzero(sizes)
    ends = np.cumsum(sizes)[full]
    i = 0
    while i < len(full):
        begin = ends[i] - sizes[full[i]]
        j = max(i + 1, int(np.searchsorted(ends, begin + CHUNK, "right")))
        chunk = places[begin : ends[j - 1]]
        starts = np.concatenate([[0], ends[i : j - 1] - begin])
        for k in range(coordinates):
            shifted = chunk + np.uint32(k * 0x9E37 + 1)
            out[full[i:j], k] = np.minimum.reduceat(_permuted(shifted), starts)
        i = j
    return out


def _rows_of(batch: pa.RecordBatch, width: int):
    ids = batch.column("doc_id")
    for first, data, offsets in S.pieces(batch.column("text")):
        sets, sizes = S.shingle_sets(*S.word_hashes(data, offsets), width)
        yield ids.slice(first, len(sizes)), sets, sizes


def _sign(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, sets, sizes in _rows_of(batch, width):
            sig = signatures(sets, sizes, bands * rows).reshape(len(sizes), bands, rows).astype(np.uint64)
            keys = np.zeros((len(sizes), bands), dtype=np.uint64)
            for r in range(rows):
                keys = S.mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r] + np.uint64(r + 1))
            keys = S.mix(keys + np.arange(1, bands + 1, dtype=np.uint64))
            ends = np.cumsum(sizes)
            digests = [xxhash.xxh3_128_digest(sets[e - n : e].tobytes()) for e, n in zip(ends, sizes)]
            keys_list = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes), pa.array(digests, pa.binary()), keys_list],
                ["doc_id", "n_shingles", "digest", "bands"],
            )


def _keys_of(ids: pa.Array) -> np.ndarray:
    return S.mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _sets(batches: Iterator[pa.RecordBatch], width: int, wanted) -> Iterator[pa.RecordBatch]:
    """Full sets of the documents in the bitmap."""
    for batch in batches:
        batch = batch.filter(pa.array(has(wanted.value, _keys_of(batch.column("doc_id")))))
        for ids, sets, sizes in _rows_of(batch, width):
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, lists], ["doc_id", "members"])


def _shared(batches: Iterator[pa.RecordBatch], shared, first: int, last: int) -> Iterator[pa.RecordBatch]:
    """(key, id, n, label) of the bands from ``first`` to ``last`` whose keys are in the bitmap."""
    for batch in batches:
        bands = batch.column("bands")
        keys = bands.flatten().to_numpy().view(np.uint64).reshape(len(bands), -1)[:, first:last]
        rows, columns = np.nonzero(has(shared.value, keys))
        at = pa.array(rows)
        own = [batch.column(c).take(at) for c in ("id", "n", "label")]
        yield pa.RecordBatch.from_arrays([pa.array(keys[rows, columns].view(np.int64)), *own], ["key", "id", "n", "label"])


def _wanted(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Hashes of the ids that share a key of the bitmap."""
    for batch in batches:
        bands = batch.column("bands")
        keys = bands.flatten().to_numpy().view(np.uint64).reshape(len(bands), -1)
        mine = batch.column("id").filter(pa.array(has(shared.value, keys).any(axis=1)))
        yield pa.RecordBatch.from_arrays([pa.array(_keys_of(mine).view(np.int64))], ["key"])


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` with the component each id is in so far."""
    rows = rows.drop("label")
    if labels is None:
        return rows.withColumn("label", F.col("id"))
    known = labels.select(F.col("node").alias("id"), F.col("component").alias("label"))
    return rows.join(known, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b), a < b: members with the hubs of their buckets, of other components. A hub is
    the member whose buckets are largest; sets of too different sizes are not linked."""
    score = buckets.groupBy("id").agg(F.sum("members").alias("score"))
    rank = F.struct("score", (-F.col("id")).alias("neg"), "label", "n")
    hubs = buckets.join(score, "id").groupBy("key").agg(F.max(rank).alias("h")).select(
        "key", (-F.col("h.neg")).alias("hub"), F.col("h.label").alias("hub_label"), F.col("h.n").alias("hub_n")
    )
    met = buckets.join(hubs, "key").filter(
        f"id <> hub AND label <> hub_label AND 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"
    )
    return met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that are linked: Jaccard similarity on the full sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y"))
    both = pairs.join(right, "b").join(left, "a")
    both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
    union = F.size("x") + F.size("y") - F.col("common")
    return both.filter(100 * F.col("common") >= percent * union).select("a", "b")


def _groups(buckets: DataFrame) -> DataFrame:
    """(g, id, label, seeks): the groups in which members of a bucket with several components meet.

    Every member meets all that are not of the bucket's largest component: these seek.
    """
    c, one = F.col, F.lit(1)
    same = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"same_{i}") for i in (1, 2)]
    of_label = buckets.groupBy("key", "label").agg(F.count(one).alias("m"), F.sum("n").alias("n"), *same)
    of_key = of_label.groupBy("key").agg(
        F.count(one).alias("labels"), F.max(F.struct("m", "n", "label")).alias("top"), F.sum("m").alias("m"),
        F.sum("n").alias("n"), *(F.bit_xor(f"same_{i}").alias(f"same_{i}") for i in (1, 2)),
    ).filter("labels > 1")
    of_key = of_key.groupBy("m", "same_1", "same_2").agg(F.min(F.struct("key", "n", "top")).alias("k"))
    m, n, top = c("m"), c("k.n"), c("k.top")
    blocks = lambda m, n: F.greatest(F.ceil(m / NESTED_HUBS), F.ceil(n / GROUP_ELEMENTS)).cast("int")
    of_key = of_key.select(
        c("k.key").alias("key"), top["label"].alias("top"), blocks(m, n).alias("all"),
        blocks(m - top["m"], n - top["n"]).alias("seekers"),
    )
    rows = buckets.join(of_key, "key").withColumn("seeks", c("label") != c("top"))
    at = lambda blocks, salt: F.pmod(F.xxhash64("id", F.lit(salt)), c(blocks)).cast("int")
    upto = lambda blocks: F.sequence(F.lit(0), c(blocks) - 1)
    found = F.transform(upto("seekers"), lambda i: F.xxhash64("key", at("all", 3), i))
    finds = F.transform(upto("all"), lambda i: F.xxhash64("key", i, at("seekers", 4)))
    both = F.when(c("seeks"), F.array_distinct(F.concat(found, finds))).otherwise(found)
    return rows.select(F.explode(both).alias("g"), "id", "label", "seeks")


def _forest(rows: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between members of a group that join its components."""
    lists = rows.column("members").combine_chunks()
    sizes, values = pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten().to_numpy().view(np.uint64)
    ids, seeks = rows.column("id").to_numpy(), np.array(rows.column("seeks").to_pylist(), dtype=bool)
    _, root = np.unique(rows.column("label").to_numpy(), return_inverse=True)
    _, where, times = np.unique(values, return_inverse=True, return_counts=True)
    met = np.flatnonzero(times[where] > 1)  # the others are in no intersection
    place = (np.cumsum(times > 1) - 1)[where[met]]
    width = (int((times > 1).sum()) >> 6) + 1
    word = np.repeat(np.arange(len(sizes)), sizes)[met] * width + (place >> 6)
    order = np.argsort(word, kind="stable")
    word, bit = word[order], np.uint64(1) << (place[order] & 63).astype(np.uint64)
    bits = np.zeros(len(sizes) * width, dtype=np.uint64)
    if len(word):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        bits[word[first]] = np.bitwise_or.reduceat(bit, first)
    bits, out = bits.reshape(-1, width), []
    for i in np.flatnonzero(seeks):
        small, large = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        others = np.flatnonzero((root != root[i]) & (100 * small >= percent * large))
        common = np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64)
        others = others[100 * common >= percent * (sizes[others] + sizes[i] - common)]
        while len(others):
            out.append((int(ids[i]), int(ids[others[0]])))
            root[root == root[others[0]]] = root[i]
            others = others[root[others] != root[i]]
    return out


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of all groups; rows come sorted by group."""
    of, held, edges = None, [], []
    for batch in batches:
        g = batch.column("g").to_numpy()
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for begin, end in zip(cuts, cuts[1:]):
            if held and g[begin] != of:
                edges += _forest(pa.Table.from_batches(held), percent)
                held = []
            of = g[begin] if end > begin else of
            held += [batch.slice(begin, end - begin)] if end > begin else []
    if held:
        edges += _forest(pa.Table.from_batches(held), percent)
    yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in edges], pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _met(rows: DataFrame) -> DataFrame:
    """Rows of keys at which two components meet, and how many rows their keys have."""
    mixed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), (F.min("label") != F.max("label")).alias("mixed"))
    return rows.join(mixed.filter("mixed").select("key", "members"), "key")


def _first_buckets(groups: DataFrame, labels: DataFrame | None, shared, first: int, last: int) -> DataFrame:
    """(key, id, n, label, members): buckets of some bands with members of several components."""
    rows = _labelled(groups, labels)  # a row per text
    rows = rows.mapInArrow(
        partial(_shared, shared=shared, first=first, last=last), "key long, id long, n long, label long"
    )
    return _met(rows)


def links(groups: DataFrame, docs: DataFrame, width: int, percent: int, bands: int) -> DataFrame | None:
    """(node, component) over representatives; ``groups`` has id, n and bands.

    Which keys two texts share and whose sets are needed is told by broadcast bitmaps of a fixed
    size, so neither texts nor all keys are shuffled; what a bitmap lets through too much is
    settled by counts.
    """
    spark = groups.sparkSession
    send = spark.sparkContext.broadcast
    counts = groups.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    shared = send(bitmap(counts.filter("n > 1")))
    if not shared.value.words.any():
        return None
    wanted = send(bitmap(groups.mapInArrow(partial(_wanted, shared=shared), "key long")))
    sets = cut(docs.mapInArrow(partial(_sets, width=width, wanted=wanted), "doc_id long, members array<long>"))
    wanted.destroy()
    labels = None
    for first, last in ((0, min(FIRST_BANDS, bands)), (FIRST_BANDS, bands)):
        if first >= last:
            continue
        buckets = cut(_first_buckets(groups, labels, shared, first, last))
        free(spark)
        if not buckets.isEmpty():
            labels = _search(buckets, sets, labels, percent)
    shared.destroy()
    return labels


def _search(buckets: DataFrame, sets: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame | None:
    """The components after all buckets' links between components are found."""
    spark = buckets.sparkSession
    labels = _joined(labels, cut(_verified(_pairs(buckets, percent), sets, percent)))
    free(spark)  # shuffles of few rows take a block each
    left = buckets if labels is None else _labelled(buckets, labels)
    met = _groups(left.select("key", "id", "n", "label")).join(sets.withColumnRenamed("doc_id", "id"), "id")
    met = met.repartition("g").sortWithinPartitions("g").select("g", "id", "label", "seeks", "members")
    found = cut(met.mapInArrow(partial(_linked, percent=percent), "a long, b long").distinct())
    del met, left
    free(spark)
    return _joined(labels, found)


def _joined(labels: DataFrame | None, found: DataFrame) -> DataFrame | None:
    """The components with some links more."""
    if found.isEmpty():
        return labels
    edges = found if labels is None else _edges(labels).unionByName(found)
    return cut(components(edges))


def _edges(labels: DataFrame) -> DataFrame:
    return labels.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
    percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    ship(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = cut(
        narrow.mapInArrow(
            partial(_sign, width=width, bands=bands, rows=rows),
            "doc_id long, n_shingles long, digest binary, bands array<long>",
        )
    )
    solid = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = solid.groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    groups = cut(groups)
    found = links(groups.select("id", "n", "bands"), narrow.filter("doc_id IS NOT NULL"), width, percent, bands)
    of_digest = groups.select(F.col("digest").alias("of"), "id")
    if found is not None:
        of_digest = of_digest.join(found.withColumnRenamed("node", "id"), "id", "left")
        of_digest = of_digest.select("of", F.coalesce("component", "id").alias("c"))
    else:
        of_digest = of_digest.withColumnRenamed("id", "c")
    out = signed.join(of_digest, F.col("digest") == F.col("of"), "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", own)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of every near-duplicate component, with its own columns."""
    result = near_duplicates(docs, doc_id, text, **options)
    (gone,) = free_name(docs, "gone_id")
    drop = result.filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(drop, F.col(doc_id) == F.col(gone), "left_anti")
