"""Queries of rule trees, schedules, questions and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import rules, trees
from lodestone.registry import query, table
from lodestone.sources import files


@query("jsn01_tree_flatten", "SELECT r_regionkey AS region, CAST(2 AS INTEGER) AS depth, s_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def jsn01(spark: SparkSession, d: str) -> DataFrame:
    leaf = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.struct(F.col("s_name").alias("name")).alias("leaf"))
    nations = table(spark, d, "nation").join(leaf, "n_nationkey").groupBy("n_regionkey", "n_name").agg(F.collect_list("leaf").alias("children"))
    regions = nations.groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("n_name").alias("name"), "children")).alias("children"))).alias("tree"))
    walked = trees.leaves(trees.walk(regions, "n_regionkey", "tree"))
    return walked.select(F.col("id").alias("region"), "depth", F.variant_get("node", "$.name", "string").alias("name"))


@query("jsn04_level_limits", "SELECT p_partkey, p_size AS units, CAST(p_partkey % 5 + 1 AS INTEGER) AS level, p_partkey % 2 = 0 AS and_higher FROM part")
def jsn04(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("At least "), F.col("p_size").cast("string"), F.lit(" units at level "), (F.col("p_partkey") % 5 + 1).cast("string"), F.when(F.col("p_partkey") % 2 == 0, " or higher").otherwise(""))
    df = table(spark, d, "part").select("p_partkey", F.get(trees.level_limits(said), F.lit(0)).alias("x"))
    return df.select("p_partkey", "x.units", "x.level", "x.and_higher")


def plans(spark: SparkSession, d: str) -> DataFrame:
    """Orders as plans: a course a part, after the part before it in the order."""
    code = F.concat(F.lit("PART"), F.lpad((F.col("l_partkey") % 10000).cast("string"), 4, "0"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan_id"), code.alias("code"), F.lit(2.0).alias("units")).repartition("plan_id").distinct()
    from pyspark.sql import Window

    before = F.lag("code").over(Window.partitionBy("plan_id").orderBy("code"))
    return lines.select("plan_id", "code", "units", F.coalesce(before, F.lit("")).alias("prerequisite"), F.array(F.lit("S1"), F.lit("S2")).alias("offered"))


@query("sim15_schedule", "WITH c AS (SELECT DISTINCT l_orderkey AS plan_id, 'PART' || lpad((l_partkey % 10000)::VARCHAR, 4, '0') AS code FROM lineitem) SELECT plan_id, code, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY code) - 1 AS INTEGER) AS slot FROM c")
def sim15(spark: SparkSession, d: str) -> DataFrame:
    return rules.schedules(plans(spark, d), n_slots=None).filter("code IS NOT NULL").select("plan_id", "code", "slot")


@query("sim16_timetable_problems")
def sim16(spark: SparkSession, d: str) -> DataFrame:
    rows = plans(spark, d)
    placed = rows.select("plan_id", "code", F.pmod(F.crc32("code"), F.lit(4)).cast("int").alias("slot"), "units", "offered")
    return rules.timetable_problems(placed, rows.filter("prerequisite <> ''").select("code", F.col("prerequisite").alias("needs")).distinct(), 8.0)


@query("sim06_assign")
def sim06(spark: SparkSession, d: str) -> DataFrame:
    rows = plans(spark, d)
    listed = rows.groupBy("plan_id").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    half = F.filter("codes", lambda x, i: i % 2 == 0)
    bins = F.to_json(F.array(F.struct(F.col("codes"), F.lit(4.0).alias("need"), F.lit(6.0).alias("cap")), F.struct(half.alias("codes"), F.lit(2.0).alias("need"), F.lit(4.0).alias("cap"))))
    return rules.assignments(rows.join(listed.select("plan_id", bins.alias("bins")), "plan_id"))


@query("str13_html_chunks")
def str13(spark: SparkSession, d: str) -> DataFrame:
    return files.chunks(files.page_texts(table(spark, d, "pages")), "page_id")


@query("src07_page_texts", "SELECT count(*) AS n FROM pages")
def src07(spark: SparkSession, d: str) -> DataFrame:
    """All pages are read; what is read of them is in src07_html_texts."""
    df = files.page_texts(table(spark, d, "pages"))
    return df.agg(F.count(F.when(F.col("_text").isNotNull() & F.col("_title").isNotNull(), 1)).alias("n"))
