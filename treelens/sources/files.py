"""Loose files: scans, ranged reads, usage, appended batches, removal; only Spark touches the paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime, content) of all files below a folder; what is not selected is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def read_at(offset: int, n: int) -> Column:
    """Bytes of a file's content from an offset."""
    return F.substring("content", offset + 1, n)


def usage(files: DataFrame, library: Column) -> DataFrame:
    """(library, files, bytes) from the files' metadata alone."""
    return files.groupBy(library.alias("library")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def append_batch(rows: DataFrame, path: str) -> None:
    """Append a batch; its files appear together when the job commits."""
    rows.write.mode("append").parquet(path)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder; whether there was one."""
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(of, True))
