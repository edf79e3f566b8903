"""Typed slots to predicates, and picks of one row a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots that compare a column of their own name.
EQUAL = ["has_exam", "has_hurdle", "midterm_status", "group_status", "level", "units", "location", "attendance_mode"]
FLAGS = {"S1": "offered_s1", "S2": "offered_s2"}


def predicates(slots: dict) -> list[Column]:
    """The predicates of slots, in a fixed order; None is no filter, False and 0 are values, unknown keys say nothing."""
    out = [F.col(k) == F.lit(slots[k]) for k in EQUAL if slots.get(k) is not None]
    if slots.get("semester") in FLAGS:
        out.append(F.col(FLAGS[slots["semester"]]))
    if slots.get("course_type_only"):
        out.append(F.col("course_type").isin(*slots["course_type_only"]))
    if slots.get("course_type_exclude"):
        out.append(~F.col("course_type").isin(*slots["course_type_exclude"]))
    if slots.get("code_level"):
        out.append(F.regexp_extract("code", "[0-9]", 0).isin(*slots["code_level"]))
    return out


def where(df: DataFrame, slots: dict, units: list[str] = (), exclude_title: list[str] = (), required: bool = True) -> DataFrame:
    """Rows that meet slots, a unit list and title exclusions; an empty predicate raises, so that no filter never means all rows."""
    found = predicates(slots)
    if kept := [u for u in units if u]:
        found.append(F.col("coordinating_unit").isin(*kept))
    found += [title_without(F.col("title"), w) for w in exclude_title]
    if not found and required:
        raise ValueError("no slot to filter by")
    return df.filter(reduce(lambda a, b: a & b, found)) if found else df


def title_without(title: Column, word: str) -> Column:
    """Null titles stay; the word is taken as it is, without wildcards."""
    return ~F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(word.lower()))


def describe(slots: dict) -> str:
    """Slots in words, in their own order."""
    one = lambda v: str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    many = lambda vs: ", ".join(one(v) for v in vs)
    said = []
    for k, v in slots.items():
        if v is None or v == []:
            continue
        said.append(f"course_type NOT IN ({many(v)})" if k == "course_type_exclude" else f"{k.removesuffix('_only')} IN ({many(v)})" if isinstance(v, list) else f"{k} = {one(v)}")
    return " AND ".join(said)


def described(slots: dict[str, Column]) -> Column:
    """describe() of slots that are columns (booleans, numbers, texts, or lists of texts), row by row; a null slot or an empty list says nothing."""
    said = []
    for k, v in slots.items():
        kind = lambda x: F.typeof(x)
        quoted = F.concat(F.lit("'"), v.cast("string"), F.lit("'"))
        if k == "course_type_exclude" or k.endswith("_only"):
            name = "course_type NOT IN (" if k == "course_type_exclude" else f"{k.removesuffix('_only')} IN ("
            said.append(F.when(F.size(v) > 0, F.concat(F.lit(name), F.array_join(F.transform(v, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit(")"))))
        else:
            said.append(F.when(v.isNotNull(), F.concat(F.lit(f"{k} = "), F.when(kind(v) == "string", quoted).otherwise(v.cast("string")))))
    return F.concat_ws(" AND ", *said)


def first_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def preferred_per_key(df: DataFrame, key: str, order: list[str], preferred: Column) -> DataFrame:
    """A row for each key, a preferred one if there is one; _position is that of the key's first row (its order columns)."""
    place = F.struct(*order)
    pick = F.struct(F.when(preferred, 0).otherwise(1).alias("p"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    row = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.min_by(row, pick).alias("_row"), F.min(place).alias("_position")).select(key, "_row.*", "_position")


def round_robin(df: DataFrame, stratum: str, order: str, per: int, most: int) -> DataFrame:
    """The i-th rows of all strata before the next ones, up to per of a stratum and most at all."""
    n = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    firsts = df.groupBy(F.col(stratum).alias("_s")).agg(F.min(order).alias("_first"))
    picked = df.withColumn("_n", n).filter(F.col("_n") <= per)  # a few rows a stratum
    return picked.join(firsts, F.col(stratum).eqNullSafe(F.col("_s"))).orderBy("_n", "_first").limit(most).drop("_s", "_first")


def every_nth(df: DataFrame, stratum: str, order: str, step: int) -> DataFrame:
    """Of each stratum the first row in order and every step-th after it."""
    n = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    return df.withColumn("_n", n).filter((F.col("_n") - 1) % step == 0).drop("_n")


#: What a free condition may not hold, and text columns that topics don't filter on.
BANNED = r"(?i)(;|--|/\*|\b(insert|update|delete|drop|alter|create|truncate|grant|revoke)\b)"
TEXT_COLUMNS = r"(?i)\b(title|description|search_blob|learning_outcomes|topics)\b"


def condition_verdict(where: Column) -> Column:
    """ok, empty, banned or text column, of a condition in words. Nothing runs such a condition; filters take slots."""
    return F.when(F.trim(F.coalesce(where, F.lit(""))) == "", "empty").when(where.rlike(BANNED), "banned").when(where.rlike(TEXT_COLUMNS), "text column").otherwise("ok")


def probed(df: DataFrame, column: str) -> DataFrame:
    """name, there and n, the values of a column; of one that the table lacks, none."""
    has = column in df.columns
    return df.agg(F.count(F.col(column) if has else F.lit(None)).alias("n")).select(F.lit(column).alias("name"), F.lit(has).alias("there"), "n")
