"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.sources.shared import shared_dir
from treelens.sources.workers import ship as ship

#: Words are maximal runs of bytes outside ASCII white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: How long the listener bus may take to pass on its events, in milliseconds.
WAIT_MS = 60_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there.

    Reliable checkpoint files survive lost executors. Where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, Spark's cleaner drops
    them when the last plan that reads them is gone; else they stay until the folder is emptied.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Tables written in the shared folder, which an operator drops when it has read them."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.what, self.kept = spark, what, []

    def __call__(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Write ``df`` and read it back, which cuts its lineage; with a folder for each value of ``by``."""
        path = scratch(self.spark, self.what)
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if by:  # else it comes last
            out = out.select(*own(df))
        self.kept.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of ``tables``, which nothing reads any more."""
        for out, path in [x for x in self.kept if any(x[0] is t for t in tables)]:
            delete(self.spark, path)
            self.kept = [x for x in self.kept if x[1] != path]

    def drop_folders(self, table: DataFrame, *folders: str) -> None:
        """Delete what ``table`` has in folders that nothing reads any more."""
        for path in [path for out, path in self.kept if out is table]:
            for folder in folders:
                delete(self.spark, f"{path}/{folder}")

    def drop_but(self, *tables: DataFrame) -> None:
        """Delete all files but those of ``tables``."""
        self.drop(*(out for out, _ in self.kept if not any(out is t for t in tables)))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark's file systems have it."""
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(of, True)


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are gone.

    It acts when the driver's collector finds the plans, which can take longer than a
    job; long operators ask for that between their phases. The listener bus holds on to the last
    query's plan until another query ends and is told to all listeners, so an empty one is run first.
    """
    gc.collect()
    spark.range(1).count()
    try:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(WAIT_MS)
    except Py4JJavaError:  # a bus that other queries keep busy: the files go later
        pass
    spark._jvm.System.gc()


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def own(df: DataFrame, *names: str) -> list[Column]:
    """The columns of those names (all of ``df`` if none), whatever characters they hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names or df.columns]


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        out.append(w)
    return out


def hash_bins(n_rows: int, rows_per_bin: int = 20_000) -> int:
    """Bits of a seeded hash that cut ``n_rows`` into bins of bounded size."""
    return min(16, max(3, (max(1, n_rows) // rows_per_bin).bit_length()))
