"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time u in [0, 1]. Its integral,
scaled to the source's target, is the source's cumulative token demand
``D(u) = target * ((1 - b) u + b u^2)``; ``b`` in (-1, 1) loads a source early or late. A
source's documents form a stream in a seeded order; the copy whose words lie
around cumulative word ``y`` gets the training position ``u = D^-1(y)``, and the copies
with a position below 1 are taken. The mix is the taken copies range-sorted by
position.

Targets: sources ordered by code point (null last) take the weights in turn and
share ``share`` of all words; no target exceeds ``cap`` times its source, the excess
goes to the others by weight (water filling, solved in closed form).

The cumulative sizes come from two levels: running sums inside bins of the
seeded order, and running sums over the bins, so that a source with a third of
all rows is cut into many tasks.

Defined results: a null text has size 0; a null source is a source of its own;
documents of size 0 are never counted; repeated rows are streamed one by one, rows with one id in the
order of a hash of their texts, as are rows without an id;
an empty table gives an empty mix; extra columns are carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelens.llm.common import cut, free_name, n_words, own

WEIGHTS = (3.0, 1.0, 2.0)
#: Schedule slopes in the order of the sources, repeating.
SLOPES = (0.0, 0.5, -0.5)
SHARE, CAP = 1.5, 2.0
ROWS_PER_BIN = 20_000


def _nth(values: tuple[float, ...], rank: Column) -> Column:
    arr = F.array(*[F.lit(float(v)) for v in values])
    return F.element_at(arr, (F.pmod(rank - F.lit(1), F.lit(len(values))) + F.lit(1)).cast("int"))


def targets(
    sizes: DataFrame, source: str, size: str, weights=WEIGHTS, slopes=SLOPES,
    share: float = SHARE, cap: float = CAP,
) -> DataFrame:
    """(source, source_size, weight, slope, target): one row per source.

    The windows run over one row per source, never over documents.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("rank", rank).select(
        "source", "source_size", "rank", _nth(weights, F.col("rank")).alias("weight"),
        _nth(slopes, F.col("rank")).alias("slope"),
    )
    every = Window.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(every) * F.lit(share))
    per = per.withColumn("most", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = F.coalesce(
        F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
    )
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("full", F.col("most") * rest <= (F.col("total") - before) * F.col("weight"))
    spent = F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("most")).otherwise(
        (F.col("total") - spent) * F.col("weight") / open_weight
    )
    return per.select("source", "source_size", "weight", "slope", target.alias("target"))


def _order_key(doc_id: Column, text: Column, seed: str) -> Column:
    """A seeded hash of the id; rows without one are told apart by their texts, or all would share a bin."""
    none = F.when(text.isNotNull(), F.concat(F.lit("null:"), F.xxhash64(text).cast("string"))).otherwise("")
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), none)))


def _position(y: Column, slope: Column) -> Column:
    """Inverse of (1 - b) u + b u^2 on [0, 1]."""
    a = F.lit(1.0) - slope
    root = (F.sqrt(a * a + F.lit(4.0) * slope * y) - a) / (F.lit(2.0) * slope)
    return F.when(slope == 0.0, y).otherwise(root)


def plan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, slopes=SLOPES, share: float = SHARE, cap: float = CAP, seed: str = "mix:",
    size: str | None = None, rows_per_bin: int = ROWS_PER_BIN,
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with size, source_size, target, taken, copies and positions.

    ``size`` names a column with known sizes; else words of ``text`` are counted.
    Returns the frame and the names given to the new columns. ``positions`` has the
    training position of each copy taken.
    """
    given = ["size", "source_size", "target", "taken", "copies", "positions"]
    names = dict(zip(given, free_name(docs, *given)))
    key, bin_, cum, slope, s_src, s_bin, before, total, weight, tie = free_name(
        docs.withColumns({v: F.lit(0) for v in names.values()}),
        "m_key", "m_bin", "m_cum", "m_slope", "m_src", "m_of_bin", "m_before", "m_total", "m_weight", "m_tie",
    )
    measure = F.col(size).cast("long") if size else n_words(F.col(text))
    words = F.col(text) if text in docs.columns else F.lit(None).cast("string")
    keyed = docs.withColumn(names["size"], measure).withColumn(key, _order_key(F.col(doc_id), words, seed))
    keyed = keyed.withColumn(tie, F.xxhash64(words))  # the text itself stays out of the windows' shuffle
    narrow = cut(keyed.select(F.col(source).alias("source"), F.col(key).alias("k"), F.col(names["size"]).alias("n")))
    digits, rows = 1, narrow.count()
    while rows > rows_per_bin * 16**digits and digits < 8:
        digits += 1
    goals = cut(targets(narrow, "source", "n", weights, slopes, share, cap))
    bins = narrow.groupBy("source", F.substring("k", 1, digits).alias("b")).agg(F.sum("n").alias("n"))
    offset = F.sum("n").over(Window.partitionBy("source").orderBy("b")) - F.col("n")
    bins = bins.select("source", "b", offset.alias("before"))
    side = bins.join(
        goals.select(F.col("source").alias("g"), "source_size", "slope", "target"),
        F.col("source").eqNullSafe(F.col("g")),
    ).select(
        F.col("source").alias(s_src), F.col("b").alias(s_bin), F.col("before").alias(before),
        F.col("source_size").alias(names["source_size"]), F.col("slope").alias(slope),
        F.col("target").alias(names["target"]),
    )
    c = F.col
    ws = Window.partitionBy(source, bin_).orderBy(key, doc_id, names["size"], tie).rowsBetween(
        Window.unboundedPreceding, 0
    )
    out = keyed.withColumn(bin_, F.substring(key, 1, digits))
    out = out.withColumn(cum, F.sum(names["size"]).over(ws))
    out = out.join(side, c(source).eqNullSafe(c(s_src)) & (c(bin_) == c(s_bin)))
    middle = c(before) + c(cum) - c(names["size"]) / F.lit(2.0)
    safe = F.greatest(c(names["source_size"]), F.lit(1))
    copies = F.greatest(F.ceil((c(names["target"]) - middle) / safe), F.lit(0)).cast("int")
    out = out.withColumn(names["copies"], F.when(c(names["size"]) > 0, copies).otherwise(F.lit(0)))
    out = out.withColumn(names["taken"], c(names["copies"]) * c(names["size"]))
    spots = F.when(
        c(names["copies"]) > 0,
        F.transform(
            F.sequence(F.lit(0), c(names["copies"]) - 1),
            lambda k: _position((middle + k * c(names["source_size"])) / c(names["target"]), c(slope)),
        ),
    ).otherwise(F.array().cast("array<double>"))
    out = out.withColumn(names["positions"], spots)
    return out.select(*own(docs), *names.values()), names


def mixed(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The mix itself: a row per copy taken, range-sorted by training position.

    Has the columns of ``docs`` plus the copy's ``position``.
    """
    rows, names = plan(docs, doc_id, **options)
    (position,) = free_name(docs, "position")
    text = options.get("text", "text")
    ties = [F.xxhash64(F.col(text))] if text in docs.columns else []
    return rows.select(*own(docs), F.explode(names["positions"]).alias(position)).orderBy(position, doc_id, *ties)
