"""Mixing sources to target weights with Efraimidis-Spirakis sampling, in DataFrame expressions only.

Each document draws the key -ln(u) / w, u from a hash of the document and w its quality weight: in ascending order of
the keys, documents come as in weighted sampling without replacement. A source whose target is m times its size
and a rest takes every document m times (complete epochs), and then documents in key order up to the rest.

The order is total, but no source is ever sorted whole: keys fall into buckets of an exponential scale, sums of buckets are
prefix-summed, and only the one bucket per source in which the rest ends is sorted. A bucket of a single
source holds under 0.4 % of it at the default, and less the more rows there are.

Defined results: a null or empty text has size 0 and is never taken; a null source is a
source of its own, the last; a null doc_id is hashed as such; rows with equal doc_id and text have equal keys and
are taken in any order among themselves; an empty table gives an empty table; a source of size 0 has target 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut

SEED = 11
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
WORD = r"[^ \t\n\x0B\f\r]+"


def quality_weight() -> Column:
    """The default weight, 0.05 to 1: high for texts of at least 50 words whose mean word length is usual in prose."""
    mean = F.length(F.coalesce("text", F.lit(""))) / F.greatest(F.col("_size"), F.lit(1))
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("_size") / 50) / (1 + F.pow(mean - 6.5, F.lit(2.0)) / 8))


def keyed(docs: DataFrame, keep: list[str], weight: Column | None, seed: int) -> DataFrame:
    """keep, with _source, _size, _key and _tie."""
    text = F.coalesce("text", F.lit(""))
    tie = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text)
    u = (F.shiftrightunsigned(F.col("_tie"), 11).cast("double") + 0.5) / F.lit(float(2**53))
    names = dict.fromkeys([*keep, "doc_id", "text"])
    df = docs.select(*names, F.col("source").alias("_source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("_size"), tie.alias("_tie"))
    return df.select(*keep, "_source", "_size", (-F.log(u) / (quality_weight() if weight is None else weight)).alias("_key"), "_tie")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """sizes (_source, _total, one row a source), with _target: shares of the budget by weight, none above most times its source.

    With sources in ascending order of cap / weight, those before some point are full and the rest share what is
    left by weight. The window without a partition holds a row per source.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    pick = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    df = sizes.withColumn("_w", F.get(F.array(*[F.lit(float(x)) for x in weights]), pick)).withColumn("_cap", most * F.col("_total").cast("double"))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    everything, before = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), by_level.rowsBetween(Window.unboundedPreceding, -1)
    budget = share * F.sum("_total").over(everything)
    left, weight_left = budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumns({"_level": left / weight_left, "_at": F.row_number().over(by_level)})
    level = F.min_by("_level", F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_at"))).over(everything)
    return df.withColumn("_target", F.least(F.col("_cap"), F.coalesce(level, F.lit(math.inf)) * F.col("_w"))).select("_source", "_total", "_target")


def mix(docs: DataFrame, keep: list[str] | None = None, weight: Column | None = None, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """keep and doc_id, with _size, _total (of the source), _target and _times, how often the mix takes the document."""
    keep = [*dict.fromkeys([*(keep or []), "doc_id"])]
    base = cut(keyed(docs, keep, weight, seed), "mix-keys")
    per_octave = max(64, math.ceil(base.count() / 400_000))
    base = base.withColumn("_bucket", F.floor(F.log2(F.greatest(F.col("_key"), F.lit(1e-300))) * per_octave).cast("long"))
    sums = base.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"))
    sums = cut(sums, "mix-buckets")
    plan = targets(sums.groupBy("_source").agg(F.sum("_sum").alias("_total")), weights, share, most)
    plan = plan.withColumn("_epochs", F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total"))).otherwise(F.lit(0)).cast("long"))
    plan = cut(plan.withColumn("_rest", F.col("_target") - F.col("_epochs") * F.col("_total")), "mix-targets")
    running = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    edge = sums.withColumn("_upto", F.sum("_sum").over(running)).join(plan.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")))
    edge = edge.filter((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_sum") < F.col("_rest")))
    edge = cut(edge.select("_s", F.col("_bucket").alias("_edge"), (F.col("_upto") - F.col("_sum")).alias("_before")), "mix-edges")
    plan = plan.withColumnRenamed("_source", "_p").join(edge, F.col("_p").eqNullSafe(F.col("_s")), "left").drop("_s")
    plan = cut(plan, "mix-plan")
    df = base.join(plan, F.col("_source").eqNullSafe(F.col("_p")))
    out = [*keep, "_source", "_size", "_total", "_target", "_times"]
    inside = F.coalesce(F.col("_bucket") == F.col("_edge"), F.lit(False))
    whole = df.filter(~inside).withColumn("_times", F.col("_epochs") + F.coalesce(F.col("_bucket") < F.col("_edge"), F.lit(False)).cast("long"))
    upto = F.sum("_size").over(Window.partitionBy("_source").orderBy("_key", "_tie", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    part = df.filter(inside).withColumn("_times", F.col("_epochs") + (F.col("_before") + upto - F.col("_size") / 2 <= F.col("_rest")).cast("long"))
    df = whole.select(*out).unionByName(part.select(*out))
    return df.withColumn("_times", F.when(F.col("_size") > 0, F.col("_times")).otherwise(F.lit(0).cast("long")))
