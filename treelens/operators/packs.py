"""Pack operators: liveness, compaction planning, pruning, sealing, batching."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from treelens.functions.scalar import dead_fraction
from treelens.sources.workers import ship


def census(objects: DataFrame, reach: DataFrame) -> DataFrame:
    """Objects and bytes of the store by their strongest reach; the parts sum to the store."""
    kind = F.when(F.col("mrn") == 1, "head").when(F.col("mrn").isNotNull(), "history").otherwise("unreferenced")
    return objects.join(reach, ["pack_id", "object_id"], "left").groupBy(kind.alias("reach")).agg(
        F.count(F.lit(1)).alias("objects"), F.sum("frame_len").alias("bytes")
    )


def pack_stats(objects: DataFrame, reach: DataFrame) -> DataFrame:
    """Per pack: objects, frame, live and head bytes, dead fraction (0 for an empty one)."""
    joined = objects.join(reach, ["pack_id", "object_id"], "left")
    live = F.sum(F.when(F.col("mrn").isNotNull(), F.col("frame_len")).otherwise(0))
    head = F.sum(F.when(F.col("mrn") == 1, F.col("frame_len")).otherwise(0))
    out = joined.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("objects"), F.sum("frame_len").alias("frame_bytes"),
        live.alias("live_bytes"), head.alias("head_bytes"),
    )
    return out.withColumn("dead_fraction", dead_fraction(F.col("frame_bytes"), F.col("live_bytes")))


def plan_compaction(stats: DataFrame, threshold: float, budget: int, young_after=None) -> DataFrame:
    """Packs over the threshold as candidate, held or too young.

    Wholly dead packs come first, then by dead fraction and id. The first pack that
    would exceed the budget is held with everything after it; budget 0 has no limit.
    One row per pack: the windows are as small as the list of packs.
    """
    young = F.lit(False) if young_after is None else F.col("sealed_at") > young_after
    over = stats.filter(F.col("dead_fraction") >= threshold).withColumn("young", young)
    order = Window.partitionBy("young").orderBy(
        (F.col("live_bytes") > 0), F.desc("dead_fraction"), "pack_id"
    ).rowsBetween(Window.unboundedPreceding, 0)
    over = over.withColumn("spent", F.sum("live_bytes").over(order)).withColumn("place", F.row_number().over(
        Window.partitionBy("young").orderBy((F.col("live_bytes") > 0), F.desc("dead_fraction"), "pack_id")
    ))
    held = F.max((F.col("spent") > budget) & F.lit(budget > 0)).over(order)
    state = F.when(F.col("young"), "too young").when(held, "held").otherwise("candidate")
    return over.select("pack_id", "live_bytes", "dead_fraction", "place", state.alias("state"))


def seal(frames: DataFrame) -> DataFrame:
    """A sealed pack's index: sorted by id, of repeated ids the first frame is kept."""
    w = Window.partitionBy("pack_id", "object_id").orderBy("frame_off")
    once = frames.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("pack_id").orderBy("object_id")))


def _fold(rows: DataFrame, key: str, order: list[str], schema: str, step: Callable) -> DataFrame:
    """Sequential folds per key over rows in order, streamed: only a key's state is held.

    ``step`` takes the state (None at a key's first row) and the row, by column name, and returns the new
    state and the row's output, if it has one.
    """
    ship(rows.sparkSession)
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), None
        for b in batches_:
            out = []
            for row in b.to_pylist():
                if row[key] != at:
                    at, state = row[key], None
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in out], schema=shape)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def rotate(frames: DataFrame, target: int) -> DataFrame:
    """(library_id, seq, pack_no): a pack is closed once it holds ``target`` bytes."""

    def fill(state, r):
        pack, held = state or (0, 0)
        held += r["size"]
        return (pack + 1, 0) if held >= target else (pack, held), (r["library_id"], r["seq"], pack)

    return _fold(frames, "library_id", ["seq"], "library_id long, seq long, pack_no long", fill)


def batches(items: DataFrame, max_items: int, max_bytes: int) -> DataFrame:
    """(library_id, seq, batch): as many as fit by count and bytes, always at least one."""

    def fill(state, r):
        batch, count, held = state or (0, 0, 0)
        if count and (count >= max_items or held + r["size"] > max_bytes):
            batch, count, held = batch + 1, 0, 0
        return (batch, count + 1, held + r["size"]), (r["library_id"], r["seq"], batch)

    return _fold(items, "library_id", ["seq"], "library_id long, seq long, batch long", fill)


def prune(index: DataFrame) -> DataFrame:
    """(library_id, pack_id) of packs all of whose ids are held elsewhere, largest files first.

    Packs with an id that only they hold can't go, so only the others are folded.
    """
    ship(index.sparkSession)
    copies = index.groupBy("library_id", "object_id").agg(F.countDistinct("pack_id").alias("copies"))
    joined = index.join(copies, ["library_id", "object_id"])
    can_go = joined.groupBy("library_id", "pack_id").agg(F.min("copies").alias("least")).filter("least > 1")
    rows = joined.join(can_go.select("library_id", "pack_id"), ["library_id", "pack_id"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        left = dict(zip(pdf["object_id"], pdf["copies"]))
        gone = []
        packs = sorted(pdf.groupby("pack_id"), key=lambda g: (-g[1]["file_bytes"].max(), g[0]))
        for pack, held in packs:
            ids = set(held["object_id"])
            if all(left[i] > 1 for i in ids):
                gone.append(pack)
                for i in ids:
                    left[i] -= 1
        return pd.DataFrame({"library_id": pdf["library_id"].iloc[0], "pack_id": gone})

    return rows.groupBy("library_id").applyInPandas(fold, "library_id long, pack_id long")


def throttle(events: DataFrame, key: str, gap: int) -> DataFrame:
    """(key, sec) of the stamps that are written: at most one per ``gap`` seconds."""

    def stamp(last, r):
        if last is None or r["sec"] - last >= gap:
            return r["sec"], (r[key], r["sec"])
        return last, None

    return _fold(events.select(key, "sec"), key, ["sec"], f"{key} {events.schema[key].dataType.simpleString()}, sec long", stamp)


def token_bucket(events: DataFrame, key: str, capacity: float, refill_seconds: float) -> DataFrame:
    """(event_id, allowed): a failure costs a token, a token comes back per ``refill_seconds``."""

    def spend(state, r):
        tokens, last = state or (capacity, None)
        if last is not None:
            tokens = min(capacity, tokens + max(0, r["sec"] - last) / refill_seconds)
        last = r["sec"] if last is None else max(last, r["sec"])
        allowed = tokens >= 1
        return (tokens - 1 if allowed else tokens, last), (r["event_id"], allowed)

    return _fold(events.select(key, "sec", "event_id"), key, ["sec", "event_id"], "event_id long, allowed boolean", spend)


def login_policy(failures: DataFrame, address: str, account: str) -> DataFrame:
    """(event_id, allowed, refused_by): failures of logins spend from two chained buckets of ten tokens, a token
    coming back every 30 seconds per address and every 60 per account. What the address's
    bucket refuses never reaches the account's."""
    rows = failures.select("event_id", "sec", F.col(address).alias("address"), F.col(account).alias("account"))
    first = rows.join(token_bucket(rows, "address", 10, 30), "event_id")
    second = token_bucket(first.filter("allowed"), "account", 10, 60).withColumnRenamed("allowed", "second")
    both = first.join(second, "event_id", "left")
    by = F.when(~F.col("allowed"), "address").when(~F.col("second"), "account")
    return both.select("event_id", by.isNull().alias("allowed"), by.alias("refused_by"))


def bloom_bits(n: int, bits_per_entry: int = 24) -> int:
    """Bits of a filter for ``n`` ids: so many per entry, up to a power of two."""
    return 1 << max(6, (max(1, n) * bits_per_entry - 1).bit_length())


def bloom_probes(object_id: str, bits: int, most: int = 17) -> list[int]:
    """Places of an id in the filter: disjoint slices of its own bits, no further hash."""
    width = bits.bit_length() - 1
    value = int(object_id, 16)
    total = 4 * len(object_id)
    return [(value >> (total - width * (i + 1))) & (bits - 1) for i in range(min(most, total // width))]


def build_bloom(ids: DataFrame, expected: int, most: int = 17) -> DataFrame:
    """(pack_id, bits, places): the set bits of each pack's filter; ids are 64 hexadecimal digits."""
    bits = bloom_bits(expected)
    width = bits.bit_length() - 1
    places = []
    for i in range(min(most, 256 // width)):  # disjoint slices of the id's own bits
        digit, skip = divmod(width * i, 4)
        digits = -(-(skip + width) // 4)
        number = F.conv(F.substring("object_id", digit + 1, digits), 16, 10).cast("long")
        places.append(F.shiftright(number, 4 * digits - skip - width).bitwiseAND(F.lit(bits - 1)))
    rows = ids.select("pack_id", F.explode(F.array(*places)).alias("place"))
    return rows.groupBy("pack_id").agg(F.lit(bits).alias("bits"), F.array_sort(F.collect_set("place")).alias("places"))
