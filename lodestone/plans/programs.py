"""Queries of program pages. Parts stand for programs: each has a page whose JSON goes by its number; the SQL states what is on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import programs
from lodestone.plans.questions import stated
from lodestone.registry import query, table

AUX = [
    '{"text": "No credit will be given for [COURSE]", "params": [{"name": "COURSE", "value": [{"code": "ZZZZ1001"}, {"code": "AAAA1000"}]}]}',
    '{"text": "No credit will be given for [C] for students completing  [P]", "params": [{"name": "C", "value": {"code": "AAAA1000"}}, {"name": "P", "value": {"plan": {"name": "Maths", "subtype": "Major"}}}]}',
    '{"text": "At most [N] units at level [L]", "params": [{"name": "N", "value": "4"}, {"name": "L", "value": 7}]}',
    '{"text": "[X] can not be undertaken with it", "params": [{"name": "X", "value": {"name": "Physics  A"}}]}',
    '{"text": "Courses can only be counted once"}',
    '{"text": "Two from each discipline", "params": []}',
    '{"text": "Talk to us"}',
]
AUX_STATED = [
    ("exclude", "No credit will be given for ZZZZ1001、AAAA1000", "AAAA1000|ZZZZ1001"),
    ("exclude_conditional", "No credit will be given for AAAA1000 for students completing Maths Major", ""),
    ("level_cap", "At most 4 units at level 7", ""),
    ("plan_conflict", "Physics A can not be undertaken with it", ""),
    ("plan_scoped", "Courses can only be counted once", ""),
    ("discipline_cap", "Two from each discipline", ""),
    ("other", "Talk to us", ""),
]


def pages(spark: SparkSession, d: str) -> DataFrame:
    """p_partkey and page: a core rule, a choice with a rule inside it, a note, an auxiliary rule, and one or two formulas."""
    aux = F.get(F.array(*map(F.lit, AUX)), (F.col("p_partkey") % len(AUX)).cast("int"))
    extra = F.when(F.col("p_partkey") % 2 == 0, ', {"ruleLogic": "Part C  OR Part D"}').otherwise("")
    code = F.concat(F.lit("PART"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"))
    core = [
        '{"header": {"partReference": "A", "title": " Core  courses", "selectionRule": {"text": "Take [N] units from ALL of the following", "params": [{"name": "N", "value": ', F.col("p_size").cast("string"),
        '}]}}, "body": [{"rowType": "CurriculumReference", "curriculumReference": {"code": "', code, '"}}, {"rowType": "EquivalenceGroup", "equivalenceGroup": [{"curriculumReference": {"code": "BBBB2000"}}, {"curriculumReference": {"code": "AAAA2000"}}]}, {"rowType": "WildCardItem", "wildCardItem": {"orgCode": "7"}}, {"rowType": "Note"}]}',
    ]
    choice = (
        '{"header": {"partReference": "B", "title": "Choice", "unitsMinimum": 4, "ruleLogic": "Part B.1"}, "body": [{"header": {"partReference": "B.1", "title": "Inner"}, "body": '
        '[{"rowType": "CurriculumReference", "curriculumReference": {"code": "MAJORX"}}, {"rowType": "CurriculumReference", "curriculumReference": {"code": "CCCC3000"}}]}]}'
    )
    parts = ['{"programRequirements": {"auxiliaryRules": [', aux, '], "logic": [{"ruleLogic": "Part A AND Part B"}', extra, '], "payload": [', *core, f', {choice}, ', '{"header": {"title": "note"}, "body": []}]}}']
    return table(spark, d, "part").select("p_partkey", F.concat(*[x if isinstance(x, F.Column) else F.lit(x) for x in parts]).alias("page"))


def nodes(spark: SparkSession, d: str, *having: str) -> DataFrame:
    return programs.objects(pages(spark, d), "p_partkey", "page", having)


@query("jsn03_rules", """SELECT p_partkey, 'A' AS ref, 'Core courses' AS title, 'Take ' || p_size || ' units from ALL of the following' AS rule_text, p_size::VARCHAR AS units_min, 'all' AS select_type, NULL AS rule_logic, '' AS children, CAST(3 AS BIGINT) AS n_items FROM part
    UNION ALL SELECT p_partkey, 'B', 'Choice', '', '4', 'select', 'Part B.1', 'B.1', 0 FROM part UNION ALL SELECT p_partkey, 'B.1', 'Inner', '', NULL, 'select', NULL, '', 2 FROM part""")
def jsn03(spark: SparkSession, d: str) -> DataFrame:
    df = programs.rules(nodes(spark, d, "header", "body"))
    return df.select(F.col("id").cast("long").alias("p_partkey"), "ref", "title", "rule_text", "units_min", "select_type", "rule_logic", F.array_join("children", "|").alias("children"), F.size("items").cast("long").alias("n_items"))


@query("jsn02_rule_codes", """SELECT p_partkey, 'A' AS ref, 'AAAA2000|BBBB2000|PART' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') AS enumerated, '' AS plans, 'AAAA2000|BBBB2000|PART' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') AS below FROM part
    UNION ALL SELECT p_partkey, 'B', '', '', 'CCCC3000' FROM part UNION ALL SELECT p_partkey, 'B.1', 'CCCC3000', 'MAJORX', 'CCCC3000' FROM part""")
def jsn02(spark: SparkSession, d: str) -> DataFrame:
    df = programs.rule_codes(programs.rules(nodes(spark, d, "header", "body")))
    return df.select(F.col("id").cast("long").alias("p_partkey"), "ref", *[F.array_join(k, "|").alias(k) for k in ("enumerated", "plans", "below")])


@query("jsn05_auxiliary", stated("kind VARCHAR, said VARCHAR, codes VARCHAR", AUX_STATED))
def jsn05(spark: SparkSession, d: str) -> DataFrame:
    df = programs.auxiliary(nodes(spark, d, "auxiliaryRules"))
    return df.select(F.col("id").cast("long").alias("p_partkey"), F.col("type").alias("kind"), F.col("text").alias("said"), F.array_join("exclude_codes", "|").alias("codes"))


@query("jsn06_formula", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '( Part A AND Part B ) AND ( Part C OR Part D )' ELSE 'Part A AND Part B' END AS formula FROM part")
def jsn06(spark: SparkSession, d: str) -> DataFrame:
    return programs.formulas(nodes(spark, d, "ruleLogic")).select(F.col("id").cast("long").alias("p_partkey"), "formula")


@query("jsn07_excluded", "SELECT p_partkey, unnest(['AAAA1000', 'ZZZZ1001']) AS course_code FROM part WHERE p_partkey % 7 = 0")
def jsn07(spark: SparkSession, d: str) -> DataFrame:
    return programs.excluded(programs.auxiliary(nodes(spark, d, "auxiliaryRules"))).select(F.col("program_id").cast("long").alias("p_partkey"), "course_code")
