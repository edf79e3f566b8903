"""Loads that can run again: upserts, replacements of children, fills, increments. Each gives the table's next state as a DataFrame.

A caller writes the state to a new folder and then names it current; parquet tables have no MERGE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    columns = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_row")).select(key, "_row.*")


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """base with the last change of each key; columns that changes lack stay as they are (null for new keys)."""
    new = last_per_key(changes, key, order)
    own = [c for c in new.columns if c != key]
    new = new.select(F.col(key).alias("_key"), F.struct(*own).alias("_new"))
    joined = base.join(new, F.col(key) == F.col("_key"), "full")
    out = [F.coalesce(key, "_key").alias(key) if c == key else F.when(F.col("_key").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in base.columns]
    return joined.select(*out)


def replace_children(base: DataFrame, children: DataFrame, parent: str) -> DataFrame:
    """base, in which the rows of each parent that has new children are these, without repeats."""
    return base.join(children.select(parent).distinct(), parent, "left_anti").unionByName(children.distinct())


def matched(rows: DataFrame, others: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows with their match, and those without one: skipped, but told."""
    return rows.join(others, key), rows.join(others.select(key), key, "left_anti")


def fill_missing(df: DataFrame, column: str, source: str, make: Callable[[Column], Column], every: bool = False) -> DataFrame:
    """Values for rows that lack one (or all) and whose source isn't blank."""
    due = (F.lit(True) if every else F.col(column).isNull()) & (F.trim(F.coalesce(F.col(source), F.lit(""))) != "")
    return df.withColumn(column, F.when(due, make(F.col(source))).otherwise(F.col(column)))


def latest_snapshot(rows: DataFrame, wanted: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return rows.join(wanted, key, "left_semi").groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def changed(df: DataFrame, old: str, new: Column) -> DataFrame:
    """Rows whose derived column differs from what is stored, a null included; with _new."""
    return df.withColumn("_new", new).filter(~F.col("_new").eqNullSafe(F.col(old)))


def hashed_vector(text: Column, size: int = 8) -> Column:
    """A deterministic stand-in for an embedding provider: of the first 8000 characters."""
    cut = F.substring(text, 1, 8000)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.round(F.pmod(F.xxhash64(cut, i), F.lit(2001)) / 1000.0 - 1, 6))


def with_vectors(base: DataFrame, rows: DataFrame, vectors: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """base after an upsert of the rows that have a vector, and how many were loaded and skipped for want of one."""
    found, skipped = matched(rows, vectors, key)
    counts = found.agg(F.count("*").alias("loaded")).join(skipped.agg(F.count("*").alias("skipped")))
    return upsert(base, found, key, order), counts


def replace_groups(base: DataFrame, rows: DataFrame, group: list[str], order: str, key: str) -> DataFrame:
    """base, in which the rows of each group that comes anew are these, numbered from 0 in order: their key is group-number."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1
    new = rows.withColumn(key, F.concat_ws("-", F.concat_ws("_", *group), n.cast("string"))).select(*base.columns)
    return base.join(rows.select(*group).distinct(), group, "left_anti").select(*base.columns).unionByName(new)
