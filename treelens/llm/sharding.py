"""Two-pass external shuffle into shards (DataFrame functions only).

Pass 1 scatters every record into memory-sized buckets by seeded hashes: the
shard by rendezvous hashing of the record's id (so one more shard takes records
only into itself), the bucket inside the shard by a second seeded hash. Pass 2
brings each bucket into one row, puts it into a canonical order, runs Spark's
Fisher-Yates ``shuffle`` on it and writes it out. A record's slot is its bucket's
offset in the shard plus its place after the shuffle, so slots are gapless from
0 and nothing larger than a bucket is ever held in memory.

Defined results: a null text counts no bytes and its CRC is that of the empty
string; a null id hashes like any other value; records with one id share a
shard; equal rows are kept, each with its own slot; an empty table writes no file and
reads back empty; extra columns are carried as they are, whatever their names, but for
maps, which have no order and are refused with a ValueError.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelens.llm.common import free_name, own

#: Bytes of text a bucket holds on average.
BUCKET_BYTES = 16 << 20
#: Buckets up to which their offsets are broadcast, else joined by a shuffle.
BROADCAST_BUCKETS = 500_000


def size_of(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + F.lit(8)).cast("long")


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Rendezvous hashing: the shard whose seeded hash of the key is largest."""
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(0), F.lit(shards - 1)),
            lambda s: F.struct(F.xxhash64(key, F.lit(seed), s).alias("h"), s.alias("s")),
        )
    )
    return best["s"]


def write_shards(
    docs: DataFrame, path: str, shards: int, doc_id: str = "doc_id", text: str = "text",
    seed: int = 17, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Shuffle ``docs`` into ``shards`` folders below ``path`` and read them back.

    Returns the columns of ``docs`` plus ``shard``, ``bucket``, ``place`` (in the
    bucket) and ``slot`` (in the shard), under other names where taken.
    """
    spark = docs.sparkSession
    shard, bucket, place, slot, rec = free_name(docs, "shard", "bucket", "place", "slot", "rec")
    total = docs.agg(F.coalesce(F.sum(size_of(F.col(text))), F.lit(0))).first()[0]
    per_shard = max(1, math.ceil(total / shards / bucket_bytes))
    inner = F.pmod(F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed + 1)), F.lit(per_shard))
    buckets = shards * per_shard
    scattered = docs.withColumn(shard, shard_of(F.col(doc_id), shards, seed)).withColumn(
        bucket, (F.col(shard) * per_shard + inner).cast("int")
    )
    # text leads the fields so that the canonical order never depends on arrival
    fields = [doc_id, text, *[c for c in docs.columns if c not in (doc_id, text)]]
    sortable = [f for f in fields if not _has_map(docs.schema[f].dataType)]
    record = F.struct(*(c.alias(f"f{i}") for i, c in enumerate(own(docs, *sortable))))
    # the bucket's number is its partition's: no two buckets share a task
    gathered = (
        scattered.repartitionById(buckets, F.col(bucket))
        .groupBy(shard, bucket)
        .agg(F.collect_list(record).alias(rec))
    )
    shuffled = gathered.select(
        shard, bucket, F.posexplode(F.shuffle(F.sort_array(F.col(rec)), seed)).alias(place, rec)
    ).select(*[F.col(rec)[f"f{sortable.index(f)}"].alias(f) for f in docs.columns], shard, bucket, place)
    (
        shuffled.sortWithinPartitions(shard, bucket, place)
        .write.partitionBy(shard).option("compression", "zstd").parquet(path)
    )
    schema = T.StructType(
        [docs.schema[f] for f in docs.columns]
        + [T.StructField(bucket, T.IntegerType()), T.StructField(place, T.IntegerType()),
           T.StructField(shard, T.IntegerType())]
    )
    back = spark.read.schema(schema).parquet(path)
    sizes = back.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias("rows_in"))
    before = F.sum("rows_in").over(Window.partitionBy(shard).orderBy(bucket)) - F.col("rows_in")
    offsets = sizes.select(F.col(bucket).alias("of_bucket"), before.alias("before"))
    if buckets <= BROADCAST_BUCKETS:  # a row per bucket
        offsets = F.broadcast(offsets)
    return back.join(offsets, F.col(bucket) == F.col("of_bucket")).withColumn(
        slot, F.col("before") + F.col(place)
    ).drop("of_bucket", "before", "rows_in")


def _has_map(t: T.DataType) -> bool:
    """Maps have no order; such columns can't take part in the canonical order."""
    if isinstance(t, T.MapType):
        raise ValueError("map columns cannot be sharded; convert them to arrays of structs")
    return False
