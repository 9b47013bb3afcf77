"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names, or the checkpoint folder that the context has.

    Where neither is set, a local session gets a folder of its own, as in tests; on a cluster that is an
    error, because executors would write where others can't read.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    ctx = spark.sparkContext
    if not ctx.getCheckpointDir():
        if not ctx.master.startswith("local") or ctx.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        ctx.setCheckpointDir(tempfile.mkdtemp(prefix="treelens-"))
    return ctx.getCheckpointDir().rstrip("/")
