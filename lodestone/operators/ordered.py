"""Windows over a whole table in one order, without one task for it all: numbers, tiles, running sums, neighbours.

The table is dealt to ranges of the order and written, so that ranges don't change; each range gives one row (how many, sums, first and last), and these rows, as many as there are
ranges, say what comes before each. What is left is a window within a range.

Defined results: the order must be total, but for rows that repeat whole (their numbers may change places); nulls order as the given columns say; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.files import scratch


def ordered(df: DataFrame, order: Sequence[Column], sums: Sequence[str] = (), neighbours: Sequence[str] = (), tiles: int = 0, ranges: int | None = None) -> DataFrame:
    """df with _number (from 1), _sum_<column> (running, this row included), _lag_<column> and _lead_<column>, and _tile (from 1, of so many) by one order of the whole table."""
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "ordered")
    df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    df = spark.read.parquet(path)
    within = Window.partitionBy("_range").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_number": F.row_number().over(within)} | {f"_sum_{c}": F.sum(c).over(upto) for c in sums} | {f"_{k}_{c}": f(F.struct(c)).over(within) for c in neighbours for k, f in (("lag", F.lag), ("lead", F.lead))})
    # A row a range; their windows are over as many rows as there are ranges.
    edge = F.struct(*neighbours) if neighbours else F.lit(0)
    each = df.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums], F.min_by(edge, "_number").alias("_first"), F.max_by(edge, "_number").alias("_last"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    at = Window.orderBy("_range")
    total = Window.partitionBy()
    each = each.select(
        F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(total).alias("_all"), *[F.sum(f"_s_{c}").over(before).alias(f"_b_{c}") for c in sums],
        F.lag("_last").over(at).alias("_prev"), F.lead("_first").over(at).alias("_next"),
    )
    df = df.join(F.broadcast(each), F.col("_range") == F.col("_r"))
    number = F.col("_number") + F.col("_before")
    out = {"_number": number}
    for c in sums:
        out[f"_sum_{c}"] = F.when(F.col(f"_b_{c}").isNull(), F.col(f"_sum_{c}")).when(F.col(f"_sum_{c}").isNull(), F.col(f"_b_{c}")).otherwise(F.col(f"_b_{c}") + F.col(f"_sum_{c}"))
    for c in neighbours:
        out[f"_lag_{c}"] = F.when(F.col(f"_lag_{c}").isNull(), F.col(f"_prev.{c}")).otherwise(F.col(f"_lag_{c}.{c}"))
        out[f"_lead_{c}"] = F.when(F.col(f"_lead_{c}").isNull(), F.col(f"_next.{c}")).otherwise(F.col(f"_lead_{c}.{c}"))
    if tiles:
        # The first tiles have one row more, as many of them as the division leaves over.
        small, more = F.floor(F.col("_all") / tiles), F.col("_all") % tiles
        out["_tile"] = F.when(number <= more * (small + 1), F.ceil(number / (small + 1))).otherwise(more + F.ceil((number - more * (small + 1)) / F.greatest(small, F.lit(1)))).cast("int")
    return df.select(*[c for c in df.columns if c not in (*out, "_range", "_r", "_before", "_all", "_prev", "_next", *(f"_b_{c}" for c in sums))], *[x.alias(k) for k, x in out.items()])
