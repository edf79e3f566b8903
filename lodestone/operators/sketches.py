"""Sketches that are kept by group and merged: distinct counts and quantiles over rollups and increments without the rows.

A sketch is a binary column: HyperLogLog for distinct values, KLL for quantiles. Merging sketches gives what a sketch of all rows would, so a coarser level, or a table with new rows,
is an aggregate of kept sketches. The stated errors hold with a chance of about 99.7 % each (three standard errors of HyperLogLog) and 99 % (KLL's rank error).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The logarithm of HyperLogLog's buckets, and KLL's size: their errors.
LG, K = 12, 400
DISTINCT_ERROR = 3 * 1.04 / (1 << LG) ** 0.5
RANK_ERROR = 2.3 / K**0.9


def kept(rows: DataFrame, by: list[str], value: str, number: str) -> DataFrame:
    """A row a group: n, the sketch of value's distinct ones, and the sketch of number's quantiles."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(value, F.lit(LG)).alias("distinct"), F.kll_sketch_agg_double(F.col(number).cast("double"), F.lit(K)).alias("quantiles"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Kept sketches at a coarser level, or of several increments."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def rolled_up(sketches: DataFrame, by: list[str]) -> DataFrame:
    """All levels of a rollup of the columns by (nulls: all), with level, how many of them are told apart."""
    out = None
    for k in range(len(by), -1, -1):
        level = merged(sketches, by[:k]).select(*[F.col(c) if i < k else F.lit(None).cast(sketches.schema[c].dataType).alias(c) for i, c in enumerate(by)], F.lit(k).alias("level"), "n", "distinct", "quantiles")
        sketches, out = level.drop("level") if k else level, level if out is None else out.unionByName(level)
    return out


def estimates(sketches: DataFrame, at: list[float]) -> DataFrame:
    """Sketches with n_distinct and q (the quantiles at)."""
    quantile = lambda x: F.kll_sketch_get_quantile_double("quantiles", F.lit(x))
    return sketches.withColumns({"n_distinct": F.hll_sketch_estimate("distinct"), "q": F.array(*[quantile(x) for x in at])}).drop("distinct", "quantiles")
