"""Two streams joined within an interval, with state on both sides that watermarks bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def followed(left: DataFrame, right: DataFrame, key: str, seconds: int, late: str) -> DataFrame:
    """Rows of left (event_id, key, ts) with other_id of the rows of right of the same key from their own time up to so many seconds later; left rows that nothing follows
    have a null, and come once the watermark has passed their interval. Rows that come later than `late` behind their stream are dropped, and counted by dropped(): Spark
    holds a batch's rows against the time that its streams had reached before the batch before it."""
    a = left.select(F.col("event_id"), F.col(key).alias("_k"), F.col("ts").cast("timestamp").alias("_t")).withWatermark("_t", late)
    b = right.select(F.col("event_id").alias("other_id"), F.col(key).alias("_k2"), F.col("ts").cast("timestamp").alias("_t2")).withWatermark("_t2", late)
    same = (F.col("_k") == F.col("_k2")) & (F.col("_t2") >= F.col("_t")) & (F.col("_t2") <= F.col("_t") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return a.join(b, same, "left_outer").select("event_id", "other_id")


def dropped(query: StreamingQuery) -> int:
    """How many rows came too late for the state of a stream that has ended."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
