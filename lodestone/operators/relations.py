"""Relations between programs and courses: look-ups without fan-out, collapses of lists and slots, and three-valued answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_name(rows: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the least name that isn't null of each key; names are reduced to one a key before the join, so no row is multiplied."""
    one = names.groupBy(key).agg(F.min(name).alias(name))
    return rows.join(one, key, "left")


def collapsed(rows: DataFrame, keys: list[str], lists: dict[str, str]) -> DataFrame:
    """A row for each key, with the distinct values of columns as sorted text and the number of rows."""
    listed = [F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "|").alias(name) for c, name in lists.items()]
    return rows.groupBy(*keys).agg(*listed, F.count("*").alias("n"))


def strongest(found: list[tuple[Column, str]], otherwise: str) -> Column:
    """The first signal, strongest first, that any row of the group gives. For use in agg()."""
    out = F
    for signal, name in found:
        out = out.when(F.coalesce(F.bool_or(signal), F.lit(False)), name)
    return out.otherwise(otherwise)


def best_of(rows: DataFrame, key: str, rank: Column, tie: list[str]) -> DataFrame:
    """Of each key the row with the least rank, the first of equals; with _rank."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(rank.alias("r"), *tie)).alias("_row"), F.min(rank).alias("_rank")).select(key, "_row.*", "_rank")


def requirement_rank(requirement: Column, one_of: Column) -> Column:
    """Hard core 0, one of several 1, elective 2."""
    return F.when((requirement == "core") & ~one_of, 0).when(requirement == "core", 1).otherwise(2)


def slots(rows: DataFrame, group: list[str], equivalence: Column, member: str, order: str) -> DataFrame:
    """Rows of one equivalence group as one slot with its members; a row without one is a slot of its own. In order of first members."""
    key = F.coalesce(equivalence.cast("string"), F.concat(F.lit("#"), F.col(order).cast("string")))
    df = rows.withColumn("_slot", key).groupBy(*group, "_slot")
    return df.agg(F.min(order).alias("first"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(member).alias("m")))), lambda x: x["m"]).alias("members")).drop("_slot")


def satisfiable_units(items: DataFrame, rule: str, units: str, equivalence: str) -> DataFrame:
    """Of each rule the units of its single courses and, for each equivalence group, of its largest one."""
    groups = items.groupBy(rule, F.coalesce(F.col(equivalence), F.concat(F.lit("#"), "item")).alias("_g")).agg(F.max(units).alias("_u"))
    return groups.groupBy(rule).agg(F.sum("_u").alias("satisfiable"))


def mandatory(select: Column, minimum: Column, satisfiable: Column, has_items: Column) -> Column:
    """Whether a selection leaves no choice: its minimum is all that it offers."""
    return select & (minimum > 0) & has_items & (F.abs(minimum - satisfiable) < 1e-6)


def permit(excluded: Column, requirement: Column) -> Column:
    """excluded, then core, then elective, else neither."""
    return F.when(excluded, "excluded").when(requirement == "core", "core").when(requirement.isNotNull(), "elective").otherwise("neither")


def ordered_distinct(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Of each key the distinct values of a column, in the order in which they first stand. Repeats go before the values meet."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("_o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias(value))


def listed_programs(rows: DataFrame, rank: str, title: str, key: str) -> DataFrame:
    """rows numbered (place) by rank, then title, a missing title last, then key: within each rank, so that no task orders all."""
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.partitionBy(rank).orderBy(F.asc_nulls_last(title), F.asc_nulls_last(key))))
