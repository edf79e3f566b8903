"""Incremental ingest: a stream of files whose rows go to a table once, however often a batch or a file comes again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest_new(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append to target the rows of new JSON files at source whose key it lacks; ends when no files are left."""

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.filter(f"`{key}` IS NOT NULL").dropDuplicates([key])
        try:
            known = spark.read.schema(schema).parquet(target).select(key)
            rows = rows.join(known, key, "left_anti")
        except Exception as e:  # the first batch: there is no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
