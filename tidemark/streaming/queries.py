"""Streams: searches on a stream of queries, and statistics of a stream of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import Engine


def search_stream(queries: DataFrame, qid: str, text: str, engine: Engine, path: str, checkpoint: str, k: int | None = None) -> StreamingQuery:
    """Searches every micro-batch of a stream of queries against the engine's tables; hits are written to ``path``.

    A batch that is done again after a failure overwrites its own folder, so hits are written once.
    """

    def one(batch: DataFrame, number: int) -> None:
        engine.search(batch, qid, text, k=k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statistics_per_window(runs: DataFrame, time: str, value: str, group: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, group, n, sum, least, most) of a stream of runs by event time; rows later than the watermark are left out."""
    w = F.window(time, window).alias("w")
    told = runs.withWatermark(time, late).groupBy(w, F.col(group).alias("group"))
    return told.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum"), F.min(value).alias("least"), F.max(value).alias("most")).select(F.col("w.start").alias("start"), "group", "n", "sum", "least", "most")
