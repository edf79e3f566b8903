"""Calibration of thresholds and comparison of answers with what was expected. A grid is a short list; rows are read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1000


def sweep(rows: DataFrame, score: str, positive: Column, low: int, high: int, scale: float) -> DataFrame:
    """For each threshold t = low / scale to high / scale in whole steps: positives at or over it, negatives under it, and accuracy.

    Rows are first counted by the last threshold that they reach, so that the sum over a threshold's rows runs on the grid.
    """
    reach = F.greatest(F.lit(low - 1), F.least(F.lit(high), F.floor(F.round(F.col(score) * scale, 6)))).cast("int")
    bins = rows.groupBy(reach.alias("bin")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    grid = rows.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("step"))
    counts = bins.agg(F.collect_list(F.struct("bin", "p", "n")).alias("bins"))  # a row a bin: at most the grid's length and one
    df = grid.join(F.broadcast(counts))
    total = lambda name, cond: F.aggregate("bins", F.lit(0).cast("long"), lambda s, x: s + F.when(cond(x), x[name]).otherwise(0))
    df = df.withColumns({"passed": total("p", lambda x: x["bin"] >= F.col("step")), "blocked": total("n", lambda x: x["bin"] < F.col("step")), "_all": total("p", lambda x: F.lit(True)) + total("n", lambda x: F.lit(True))})
    return df.select((F.col("step") / scale).alias("threshold"), "passed", "blocked", ((F.col("passed") + F.col("blocked")) / F.col("_all")).alias("accuracy"))


def best_threshold(swept: DataFrame, highest: bool = True) -> DataFrame:
    """The threshold with the best accuracy, the highest (or lowest) of equals."""
    tie = F.col("threshold") if highest else -F.col("threshold")
    return swept.agg(F.max_by("threshold", F.struct("accuracy", tie)).alias("threshold"), F.max("accuracy").alias("accuracy"))


def floors(swept: DataFrame, signals: DataFrame) -> DataFrame:
    """max_keep, the highest threshold that keeps all signals, and best, the lowest with the most signals kept and noise cut, with both numbers."""
    df = swept.join(F.broadcast(signals.agg(F.count("*").alias("_n"))))
    right = F.col("passed") + F.col("blocked")
    first = F.min_by(F.struct("threshold", "passed", "blocked"), F.struct(-right, F.col("threshold")))
    df = df.agg(F.max(F.when(F.col("passed") == F.col("_n"), F.col("threshold"))).alias("max_keep"), first.alias("_x"))
    return df.select("max_keep", F.col("_x.threshold").alias("best"), F.col("_x.passed").alias("kept"), F.col("_x.blocked").alias("cut"))


def overlap(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """How many negatives reach the least positive score, and how many positives lie at or under the largest negative one."""
    edges = rows.agg(F.min(F.when(positive, F.col(score))).alias("_low"), F.max(F.when(~positive, F.col(score))).alias("_high"))
    return rows.join(F.broadcast(edges)).agg(F.count_if(~positive & (F.col(score) >= F.col("_low"))).alias("negatives_over"), F.count_if(positive & (F.col(score) <= F.col("_high"))).alias("positives_under"))


def separability(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """The cut among all scores with the best accuracy, the lowest of equals. Scores are counted first; they fall into BINS bins of their range, whose
    running sums are a few rows, so that the running sums over scores stay within a bin."""
    from pyspark.sql import Window

    counts = rows.groupBy(F.col(score).alias("cut")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    edges = counts.agg(F.min("cut").alias("_low"), F.max("cut").alias("_high"), F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    share = F.when(F.col("_high") > F.col("_low"), (F.col("cut") - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    counts = counts.join(F.broadcast(edges)).withColumn("_bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.groupBy(F.col("_bin").alias("_b")).agg(F.sum("p").alias("_bp"), F.sum("n").alias("_bn"))
    bins = bins.select("_b", F.coalesce(F.sum("_bp").over(before), F.lit(0)).alias("_bp"), F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_bn"))
    inside = Window.partitionBy("_bin").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    under = lambda x: F.coalesce(F.sum(x).over(inside), F.lit(0))
    df = counts.select("cut", "_bin", "_p", "_n", under("p").alias("_pu"), under("n").alias("_nu")).join(F.broadcast(bins), F.col("_bin") == F.col("_b"))
    df = df.select("cut", (F.col("_p") - F.col("_bp") - F.col("_pu") + F.col("_bn") + F.col("_nu")).alias("ok"), (F.col("_p") + F.col("_n")).alias("_all"))
    return df.agg(F.max_by("cut", F.struct("ok", -F.col("cut"))).alias("cut"), F.max(F.col("ok") / F.col("_all")).alias("accuracy"))


def precision_recall(found: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    both = found.select(key).distinct().withColumn("_f", F.lit(1)).join(wanted.select(key).distinct().withColumn("_w", F.lit(1)), key, "full")
    df = both.agg(F.count_if(F.col("_f").isNotNull() & F.col("_w").isNotNull()).alias("hit"), F.count("_f").alias("nf"), F.count("_w").alias("nw"))
    return df.select((F.col("hit") / F.col("nf")).alias("precision"), (F.col("hit") / F.col("nw")).alias("recall"), ((F.col("hit") == F.col("nf")) & (F.col("hit") == F.col("nw"))).alias("exact"))
