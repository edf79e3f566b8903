"""Queries that run as streams: a table is dealt to files in order of time, and read a few files a batch."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.registry import query, table
from lodestone.sources.files import scratch
from lodestone.streaming import increments, joins, limiter

#: Files of a batch, and batches in which a table comes.
FILES, BATCHES = 2, 3
#: Fixed value: the state store that keeps state by columns.
_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def in_batches(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    """A stream whose batches are the parts, in order."""
    path = scratch(spark, "stream")
    # A part of a few rows might leave a file empty, that is unwritten, and so move the batches.
    files = FILES if min(df.count() for df in parts) >= 1000 else 1
    for df in parts:
        df.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(path)


def by_time(df: DataFrame, n: int = BATCHES) -> list[DataFrame]:
    """df in n parts by ts."""
    low, high = df.agg(F.min("ts"), F.max("ts")).first()
    edges = [low + (high - low) * i / n for i in range(1, n)] if low is not None else []
    part: Column = sum((F.col("ts") >= F.lit(e)).cast("int") for e in edges) if edges else F.lit(0)
    return [df.filter(part == i) for i in range(len(edges) + 1)]


def run(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, StreamingQuery]:
    """What a stream has given when nothing is left to read."""
    out, at = scratch(spark, "streamed"), scratch(spark, "stream-state")
    ended = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
    ended.awaitTermination()
    return spark.read.schema(df.schema).parquet(out), ended


LATE = "event_id % 17 = 0 AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 4 FROM events)"


@query("stm10_stream_join", f"""WITH e AS (SELECT event_id, user_id, event_type, CAST(ts AS TIMESTAMP) AS ts FROM events), l AS (SELECT event_id FROM events WHERE {LATE}),
    p AS (SELECT * FROM e WHERE event_type = 'purchase' AND event_id NOT IN (FROM l)), c AS (SELECT * FROM e WHERE event_type = 'click' AND event_id NOT IN (FROM l))
    SELECT p.event_id, c.event_id AS other_id, (SELECT count(*) FROM events WHERE event_type IN ('purchase', 'click') AND {LATE}) AS dropped
    FROM p LEFT JOIN c ON p.user_id = c.user_id AND c.ts >= p.ts AND c.ts <= p.ts + INTERVAL 6 HOUR""")
def stm10(spark: SparkSession, d: str) -> DataFrame:
    """Purchases and the clicks of their user within six hours, of two streams. Some rows of the first quarter come after all others, too late; a last batch moves time on, so that
    what nothing has followed comes out too."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    late = (F.col("event_id") % 17 == 0) & (F.col("ts") < F.lit(low + (high - low) / 4))
    end = spark.createDataFrame([(-1, -1, k, high) for k in ("purchase", "click")], events.schema).withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 DAYS"))
    stream = in_batches(spark, [*by_time(events.filter(~late)), events.filter(late), end])
    with settings(spark, {"spark.sql.streaming.noDataMicroBatches.enabled": "true"}):  # the last rows come out in a batch without data
        found, ended = run(spark, joins.followed(stream.filter("event_type = 'purchase'"), stream.filter("event_type = 'click'"), "user_id", 6 * 3600, "1 hour"))
    return found.filter("event_id >= 0").withColumn("dropped", F.lit(joins.dropped(ended)).cast("long"))


ALLOWED = "SELECT event_id, row_number() OVER (PARTITION BY user_id, floor(epoch_us(ts) / {us}) ORDER BY ts, event_id) <= {cap} AS allowed FROM events"


@query("stm01_stream", ALLOWED.format(us=7200 * 1_000_000, cap=1))
def stm01(spark: SparkSession, d: str) -> DataFrame:
    """At most one event of a user in two hours, decided on a stream."""
    with settings(spark, _STORE):
        return run(spark, limiter.stream_allowed(in_batches(spark, by_time(table(spark, d, "events").select("event_id", "user_id", "ts"))), "user_id", 7200, 1))[0]


@query("stm03_bounded", ALLOWED.format(us=7200 * 1_000_000, cap=1).replace(" FROM events", ", true AS bounded FROM events"))
def stm03(spark: SparkSession, d: str) -> DataFrame:
    """The same with a bound of 10,000 keys on the state."""
    with settings(spark, _STORE):
        found, _ = run(spark, limiter.bounded_allowed(in_batches(spark, by_time(table(spark, d, "events").select("event_id", "user_id", "ts"))), "user_id", 7200, 1, 10_000))
    return found.select("event_id", "allowed", (F.col("held") <= 10_000 // limiter.SHARES).alias("bounded"))


@query("stm06_ingest", "SELECT conv_id * 1000 + turn AS id, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY 1) = 1")
def stm06(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as JSON files, of which the second half comes twice and repeats the first: each is ingested once."""
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text").dropDuplicates(["id"])
    source, target, at = (scratch(spark, f"ingest-{x}") for x in ("in", "out", "state"))
    for part in (rows.filter("id % 2 = 0"), rows):
        part.write.mode("append").json(source)
        increments.ingest_new(spark, source, rows.schema, target, at, "id").awaitTermination()
    return spark.read.schema(rows.schema).parquet(target)
