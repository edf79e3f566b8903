"""Joins by order: rows in intervals, intervals that overlap, and the latest row before a time. All are equi-joins or windows of bounded groups; no plan has a cross join.

Intervals go by a grid as wide as they are long: an interval of a length from 2^l to 2^(l+1) touches three cells of width 2^l at most. A point looks into one cell of
each width that occurs, so neither very long intervals nor very short ones copy rows beyond that. A cell that holds too much is a skewed join, which Spark splits on both sides.

Defined results: intervals hold their begin and not their end; empty ones (or of a null end) hold and overlap nothing; a null time or key meets nothing; rows that repeat give
a row for each pair; bounds are longs (a timestamp goes as microseconds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of time that a key's rows are dealt to, so that one key with most rows is no one task's.
RANGES = 64


def _level(lo: Column, hi: Column) -> Column:
    """The l of an interval: its length is at least 2^l and less than 2^(l+1)."""
    return (F.length(F.bin(hi - lo)) - 1).cast("int")


def _cells(lo: Column, hi: Column, level: Column) -> Column:
    return F.sequence(F.call_function("shiftright", lo, level), F.call_function("shiftright", hi - 1, level))


def _placed(df: DataFrame, lo: str, hi: str) -> DataFrame:
    return df.filter(F.col(lo) < F.col(hi)).withColumn("_l", _level(F.col(lo), F.col(hi)))


def _levels(df: DataFrame) -> list[int]:
    return sorted(r["_l"] for r in df.select("_l").distinct().collect())  # 63 at most


def interval_join(points: DataFrame, at: str, intervals: DataFrame, lo: str, hi: str, by: list[tuple[str, str]] | None = None) -> DataFrame:
    """Pairs of points and intervals with lo <= at < hi, and equal columns by (of points, of intervals). Columns of the two sides must have names of their own."""
    placed = _placed(intervals, lo, hi)
    levels = _levels(placed)
    cells = placed.select("*", F.explode(_cells(F.col(lo), F.col(hi), F.col("_l"))).alias("_c"))
    looks = F.array(*[F.struct(F.lit(k).alias("l"), F.shiftright(F.col(at), k).alias("c")) for k in levels]) if levels else F.array().cast("array<struct<l: int, c: bigint>>")
    looking = points.select("*", F.explode(looks).alias("_x")).select(*points.columns, F.col("_x.l").alias("_pl"), F.col("_x.c").alias("_pc"))
    same = (F.col("_pl") == F.col("_l")) & (F.col("_pc") == F.col("_c")) & (F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))
    for a, b in by or []:
        same &= F.col(a) == F.col(b)
    return looking.join(cells, same).select(*points.columns, *intervals.columns)


def overlap_join(left: DataFrame, right: DataFrame, lo: tuple[str, str], hi: tuple[str, str], by: list[tuple[str, str]] | None = None) -> DataFrame:
    """Pairs of intervals of both sides (lo and hi: their columns' names) that have a time in common. Of a pair the shorter one looks for the longer one's width; a pair
    that meets in several cells counts in the one in which both have begun."""
    a, b = _placed(left, lo[0], hi[0]).withColumnRenamed("_l", "_la"), _placed(right, lo[1], hi[1]).withColumnRenamed("_l", "_lb")
    levels = sorted({*_levels(a.select(F.col("_la").alias("_l"))), *_levels(b.select(F.col("_lb").alias("_l")))})
    every = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")

    def looking(df: DataFrame, lo: str, hi: str, own: str, k: str) -> DataFrame:
        df = df.select("*", F.explode(F.filter(every, lambda x: x >= F.col(own))).alias(f"_k{k}"))
        return df.select("*", F.explode(_cells(F.col(lo), F.col(hi), F.col(f"_k{k}"))).alias(f"_c{k}"))

    a, b = looking(a, lo[0], hi[0], "_la", "a"), looking(b, lo[1], hi[1], "_lb", "b")
    same = (F.col("_ka") == F.col("_kb")) & (F.col("_ca") == F.col("_cb")) & (F.col(lo[0]) < F.col(hi[1])) & (F.col(lo[1]) < F.col(hi[0]))
    same &= F.col("_ka") == F.greatest("_la", "_lb")
    same &= F.col("_ca") == F.call_function("shiftright", F.greatest(*lo), F.col("_ka"))
    for x, y in by or []:
        same &= F.col(x) == F.col(y)
    return a.join(b, same).select(*left.columns, *right.columns)


def _ranges(df: DataFrame, at: str, n: int) -> Column:
    """The number of the range that a time falls into, of n of about equal numbers of rows: a search in a tree of cuts."""
    cuts = sorted({int(x) for x in df.select(F.percentile_approx(at, [i / n for i in range(1, n)], 10 * n).alias("x")).first()["x"] or []})  # n numbers

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(at) < cuts[mid], tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(cuts))


def asof_join(left: DataFrame, right: DataFrame, at: tuple[str, str], by: tuple[str, str], value: list[str], ranges: int = RANGES) -> DataFrame:
    """left with value (columns of right) of the row of right that is the latest at or before each of left, of the same key; nulls where there is none. Of rows of right
    with one key and time that with the greatest values counts.

    Both sides are one table, sorted once in each key and range of time; what a range begins with comes from the ranges before it, by a row for each key and range.
    """
    t, key = at[0], by[0]
    own = [c for c in left.columns]
    rows = left.select(F.col(t).alias("_t"), F.col(key).alias("_k"), F.struct(*own).alias("_row"), F.lit(None).cast(right.select(F.struct(*value).alias("x")).schema["x"].dataType).alias("_v"))
    others = right.filter(F.col(at[1]).isNotNull() & F.col(by[1]).isNotNull()).groupBy(F.col(at[1]).alias("_t"), F.col(by[1]).alias("_k")).agg(F.max(F.struct(*value)).alias("_v"))
    both = rows.unionByName(others.select("_t", "_k", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_v"))
    own_range = _ranges(others, "_t", ranges)
    both = both.withColumn("_g", own_range)
    # The last of each range, carried to the ranges after it.
    last = others.withColumn("_g", own_range).groupBy("_k", "_g").agg(F.max_by("_v", "_t").alias("_v"))
    seen = last.select("_k", "_g", "_v").unionByName(both.filter("_row IS NOT NULL").select("_k", "_g", F.lit(None).cast(last.schema["_v"].dataType).alias("_v")).distinct())
    before = Window.partitionBy("_k").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    begins = seen.groupBy("_k", "_g").agg(F.first("_v", ignorenulls=True).alias("_v")).select(F.col("_k").alias("_k2"), F.col("_g").alias("_g2"), F.last("_v", ignorenulls=True).over(before).alias("_before"))
    upto = Window.partitionBy("_k", "_g").orderBy("_t", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_v", F.last("_v", ignorenulls=True).over(upto)).filter("_row IS NOT NULL")
    found = found.join(begins, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_g") == F.col("_g2")), "left")
    known = F.when(F.col("_t").isNotNull() & F.col("_k").isNotNull(), F.coalesce("_v", "_before"))
    return found.select("_row.*", known.alias("_found")).select(*own, *[F.col(f"_found.{c}").alias(c) for c in value])
