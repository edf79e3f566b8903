"""Connected components of a table of links, by alternating stars.

Defined results: links of a node to itself don't count, nor do repeated ones; a null end is an error of the caller's; no links give an empty
table. A run that doesn't converge raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, discard


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Each node hands its least neighbour on: to its larger neighbours, or (small) to its smaller ones and itself."""
    if small:
        rows = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        rows = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # A hub's neighbourhood is aggregated before it is shuffled, and its rows in the join are split where they are many.
    least = rows.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).withColumn("m", F.least("w", "m"))
    rows = rows.join(least, F.col("u") == F.col("w"))
    if small:
        out = rows.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    else:
        out = rows.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """node and root (the least node of its component) of every node of links (a, b: longs)."""
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    mark = None
    for _ in range(rounds):
        before, links = links, cut(_star(_star(links, small=False), small=True), "stars")
        discard(before)
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h"), F.countDistinct("a").alias("d")).first()
        if now == mark or now["n"] == 0:
            return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        mark = now
    raise RuntimeError(f"components haven't converged in {rounds} rounds")
