"""Python workers: how they get this package, and how much they are sent at once."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Rows of an Arrow batch sent to the Python workers, at most.
ARROW_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context."""
    ctx = spark.sparkContext
    # texts are long: fewer rows to an Arrow batch bound the workers' memory
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if getattr(ctx, "_treelens_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="treelens-zip-"), "treelens.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    ctx.addPyFile(target)
    ctx._treelens_shipped = True
