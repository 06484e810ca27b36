"""What the operators of this subpackage share: tables, settled intermediate results, Arrow batches."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from spanloom.store import settle, shared_dir

__all__ = ["BATCH_BYTES", "settle", "shared_dir", "ship", "table"]

#: Upper bound of the bytes of one Arrow batch that goes to a Python worker.  A single longer text is a batch of its own.
BATCH_BYTES = 8 << 20

_shipped: set[str] = set()


def ship(context: SparkContext) -> None:
    """Give the executors this package, once a context: Spark's own file server carries it."""
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp()
        context.addPyFile(shutil.make_archive(os.path.join(folder, package.name), "zip", package.parent, package.name))
        atexit.register(shutil.rmtree, folder, True)
        _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory; any path that Spark's readers can open."""
    ship(spark.sparkContext)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
