"""Session helpers: tables, checkpoint folder, checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A side is broadcast only when it has been counted and holds no more rows than this.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_folder(spark: SparkSession) -> None:
    """Names the folder of checkpoints, unless one is set.

    ``spark.checkpoint.dir`` is read from the session; only where neither it nor a checkpoint folder is set (tests
    on one machine) a temporary folder is made, and removed when the process ends.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder the cluster names."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Removes the shuffle files that led to a checkpoint; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def rows_within(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than that."""
    return df.limit(most + 1).count() <= most


def checked_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted size allows it, else df as it is (shuffle join)."""
    return F.broadcast(df) if rows_within(df, most) else df


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """df with the position of every row, from 0, in the order of the given columns.

    Rows are sorted in ranges; a row's number is its place in its range plus the rows of the ranges before, of
    which there is one count each. No task gets all rows, as with a window over the whole table.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # ids count up within a range and have its number in the upper bits; the checkpoint fixes them
    placed = checkpoint(ranged.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")


def shared_folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder, not made yet, below the checkpoint folder, which all executors share."""
    sc = spark.sparkContext
    _checkpoint_folder(spark)
    base = sc._jsc.sc().getCheckpointDir().get()
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/{name}-{uuid.uuid4().hex}"


class Shared:
    """A value of checked size that is sent to every executor, and what a worker makes of it, once for all its tasks."""

    _made: ClassVar[dict[str, object]] = {}

    def __init__(self, spark: SparkSession, value: object, make: Callable[[object], object]):
        self.name, self.held, self.make = uuid.uuid4().hex, spark.sparkContext.broadcast(value), make

    def get(self) -> object:
        if self.name not in Shared._made:
            Shared._made.clear()
            Shared._made[self.name] = self.make(self.held.value)
        return Shared._made[self.name]
