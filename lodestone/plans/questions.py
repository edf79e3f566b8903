"""Queries of the question planner. Parts stand for users: each asks one of a few questions, and the SQL states what the answer is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import planner
from lodestone.registry import query, table

DOMAINS = {"level": ["Undergraduate", "Postgraduate Coursework"], "location": ["St Lucia"], "attendance_mode": ["In Person"], "coordinating_unit": ["Music School", "Physics School"]}


def _sql(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (bool, int, float)) else "'" + str(x).replace("'", "''") + "'"


def stated(columns: str, rows: list[tuple]) -> str:
    """SQL with an answer for each part, by the number of its question. columns: name and type of each."""
    names = [x.split() for x in columns.split(", ")]
    values = ", ".join(f"({i}, {', '.join(map(_sql, r))})" for i, r in enumerate(rows))
    out = ", ".join(f"CAST(v.{n} AS {t}) AS {n}" for n, t in names)
    return f"SELECT p_partkey, {out} FROM part JOIN (VALUES {values}) v(k, {', '.join(n for n, _ in names)}) ON p_partkey % {len(rows)} = v.k"


def asked(spark: SparkSession, d: str, **columns: list) -> DataFrame:
    """Parts with the columns' values, dealt by number."""
    pick = lambda xs: F.get(F.array(*[F.lit(x).cast("string") for x in xs]), (F.col("p_partkey") % len(xs)).cast("int"))
    return table(spark, d, "part").select("p_partkey", *[pick(v).alias(k) for k, v in columns.items()])


#: Codes of the cases, and by what their numbers become each part's own.
OWN_CODES = {"OBOE2200": 7, "HARP3100": 13, "ABCD1234": 17, "WXYZ2001": 19, "wxyz2001": 19, "AAAA1000": 23, "BBBB1000": 29}


def own_codes(x: F.Column) -> F.Column:
    """A text in which each part's codes have numbers of their own."""
    for code, k in OWN_CODES.items():
        x = F.replace(x, F.lit(code), F.concat(F.lit(code[:4]), (1000 + F.col("p_partkey") * k % 9000).cast("string")))
    return x


def own_codes_sql(sql: str, *columns: str) -> str:
    for code, k in OWN_CODES.items():
        found = ", ".join(f"replace({c}, '{code}', '{code[:4]}' || (1000 + p_partkey * {k} % 9000)) AS {c}" for c in columns)
        sql = f"SELECT * REPLACE ({found}) FROM ({sql})"
    return sql


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Parts with q: a question each, about the part by its name, which says nothing that a planner looks for."""
    df = asked(spark, d, q=QUESTIONS).join(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    return df.select("p_partkey", F.concat(F.lit("about the "), "p_name", F.lit(": "), "q", F.lit(" (the "), "p_name", F.lit(")")).alias("q"))


def joined(x: F.Column) -> F.Column:
    return F.array_join(x, "|")


ARTS = "Communication & Arts School|Languages & Cultures School|Historical & Philosophical Inq|Music School|Humanities, Arts and Social Sciences|Politic Sc & Internat Studies"
QUESTIONS = [
    "electives without exam or research project, both S1 and S2",
    "compulsory business courses for undergraduates starting with 2 or 3",
    "liberal arts without thesis, placement at Gatton online",
    "postgraduate courses with group work and no exam in person at St Lucia",
    "3xxx or 7xxx about quiz assessment",
    "what are the prerequisites, units and semester of it",
    "排除论文和实习,1或3开头的研究生课,没有小组作业",
    "master students: no team assessment, two semester 1 and semester 2 classes",
    "master of arts",
    "",
]


@query("nlp04_intents", stated("exam BOOLEAN, grouped BOOLEAN, both_semesters BOOLEAN", [
    (False, None, True), (None, None, False), (None, None, False), (False, True, False), (None, None, False), (None, None, False), (None, False, False), (None, False, False), (None, None, False), (None, None, False),
]))
def nlp04(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    return questions(spark, d).select("p_partkey", planner.exam_intent(q).alias("exam"), planner.group_intent(q).alias("grouped"), planner.both_semesters(q).alias("both_semesters"))


@query("nlp05_exclusions", stated("types VARCHAR, titles VARCHAR", [
    ("research", "project|research"), ("", ""), ("placement|thesis", "thesis|placement|internship|practicum"), ("", ""), ("", ""), ("", ""), ("placement|thesis", "placement|internship|practicum"), ("", ""), ("", ""), ("", ""),
]))
def nlp05(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    return questions(spark, d).select("p_partkey", joined(planner.excluded_types(q)).alias("types"), joined(planner.excluded_titles(q)).alias("titles"))


@query("nlp06_code_levels", stated("digits VARCHAR, level VARCHAR", [
    ("", None), ("2|3", "Undergraduate"), ("", None), ("", "Postgraduate Coursework"), ("3|7", None), ("", None), ("1|3", "Postgraduate Coursework"), ("", "Postgraduate Coursework"), ("", None), ("", None),
]))
def nlp06(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    return questions(spark, d).select("p_partkey", joined(planner.first_digits(q)).alias("digits"), planner.level_hint(q).alias("level"))


@query("nlp02_guards", stated("location VARCHAR, attendance VARCHAR", [
    ("Here", None), ("Here", None), ("Gatton", "Online"), ("Here", "In Person"), ("Here", None), ("Here", None), ("Here", None), ("Here", None), ("Here", None), ("Here", None),
]))
def nlp02(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    location = planner.guarded(F.lit("Here"), planner.asked_campus(q), DOMAINS["location"])
    return questions(spark, d).select("p_partkey", location.alias("location"), planner.guarded(F.lit(None).cast("string"), planner.asked_attendance(q), DOMAINS["attendance_mode"]).alias("attendance"))


@query("nlp08_units", stated("units VARCHAR, requirement VARCHAR", [
    ("", "elective"), ("Business School|Economics School", "core"), (ARTS, None), ("", None), ("", None), ("", None), ("", None), ("", None), (ARTS, None), ("", None),
]))
def nlp08(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    return questions(spark, d).select("p_partkey", joined(planner.faculty_units(q)).alias("units"), planner.requirement(q).alias("requirement"))


def items() -> F.Column:
    return F.array(F.struct(F.lit("Weekly quiz").alias("task"), F.lit("Examination").alias("category")), F.struct(F.lit("Paper").alias("task"), F.lit("Essay, Project").alias("category")))



@query("nlp16_detail_intents", stated("details VARCHAR, kind VARCHAR, has_one VARCHAR", [
    ("", "project", "yes"), ("", None, None), ("", None, None), ("", None, None), ("assessment", "quiz", "yes"), ("prereq|units|semester", None, None), ("", "essay", "yes"), ("assessment|semester", None, None), ("", None, None), ("", None, None),
]).replace("CAST(v.has_one AS VARCHAR) AS has_one", "CASE WHEN v.kind IS NOT NULL AND p_partkey % 3 = 0 THEN 'unknown' WHEN v.kind IS NOT NULL AND p_partkey % 3 = 1 THEN 'no' ELSE v.has_one END AS has_one"))
def nlp16(spark: SparkSession, d: str) -> DataFrame:
    q, kind = F.col("q"), planner.assessment_type(F.col("q"))
    other = F.array(F.struct(F.lit("Talk").alias("task"), F.lit(None).cast("string").alias("category")))
    own = F.when(F.col("p_partkey") % 3 == 1, other).when(F.col("p_partkey") % 3 == 2, items())
    return questions(spark, d).select("p_partkey", joined(planner.detail_intents(q)).alias("details"), kind.alias("kind"), planner.has_assessment(kind, own).alias("has_one"))


DRAFTS = [
    '{"filters": {"has_exam": true, "has_hurdle": 1, "midterm_status": " HAS ", "units": 2, "level": "undergraduate ", "location": "Mars", "code_level": [3, "1", "x", 3], "nonsense": 4}}',
    '{"filters": {"has_exam": "false", "group_status": "some", "units": true, "level": "Honours", "location": " ", "semester": "S3", "course_type_only": ["Thesis", "coursework", "thesis", 4]}}',
    '{"filters": {"has_hurdle": false, "group_status": "none", "units": " 2.5", "semester": " S1 ", "attendance_mode": "Online", "course_type_exclude": "thesis", "code_level": []}}',
    '{"filters": {"units": "two", "midterm_status": null, "course_type_exclude": ["placement", "dance"]}}',
    '{"filters": 7}',
    "no json",
]


@query("nlp01_slots", stated("has_exam BOOLEAN, has_hurdle BOOLEAN, midterm_status VARCHAR, group_status VARCHAR, level VARCHAR, units DOUBLE, location VARCHAR, attendance_mode VARCHAR, semester VARCHAR, excluded VARCHAR, only_types VARCHAR, digits VARCHAR", [
    (True, None, "has", None, "undergraduate", 2.0, "Mars", None, None, None, None, "1|3"),
    (None, None, None, None, None, None, None, None, None, None, "coursework|thesis", None),
    (None, False, None, "none", None, 2.5, None, "Online", "S1", None, None, None),
    (None, None, None, None, None, None, None, None, None, "placement", None, None),
    (None,) * 12,
    (None,) * 12,
]))
def nlp01(spark: SparkSession, d: str) -> DataFrame:
    slots = planner.validated(F.col("v"), DOMAINS)
    df = asked(spark, d, draft=DRAFTS).withColumn("v", planner.parsed(F.col("draft")))
    lists = {"course_type_exclude": "excluded", "course_type_only": "only_types", "code_level": "digits"}
    return df.select("p_partkey", *[joined(x).alias(lists[k]) if k in lists else x.alias(k) for k, x in slots.items()])


ASKED = [
    ("躺平的本科课", None),
    ("ABCD1234 怎么样", None),
    ("ABCD1234 怎么样 考试", None),
    ("can I take WXYZ2001 in the Bachelor of Science", None),
    ("which programs have wxyz2001 as core", None),
    ("core courses of the Master of CS without exam, 3xxx", None),
    ("when is the census date", '{"mode": "kb", "kb_query": "census date"}'),
    ("machine learning subjects in S1", '{"mode": "filter", "filters": {"semester": "S1", "has_exam": "no", "units": "2"}}'),
    ("anything at Gatton", '{"mode": "semantic", "semantic_query": "anything"}'),
    ("something nice", None),
    ("about robotics", None),
    ("courses", 'Here: {"mode": "program", "direction": "program_to_courses", "program_name": "made up"} done'),
    ("2 units please", '{"mode": "program"}'),
    ("business electives", '{"mode": "semantic", "semantic_query": "biz", "filters": {"level": "undergraduate", "coord_unit": "Music School"}}'),
    ("nothing", "not json"),
    ("both S1 and S2 with Honours", '{"mode": "filter", "filters": {"semester": "S2", "level": "Honours"}}'),
    ("tell me", '{"mode": "dance"}'),
    ("master of CS", '{"mode": "course_detail", "course_code": "zzzz"}'),
]
PLANS = [
    ("filter", "", "", "", "", "", "assessments_asc", "", False),
    ("guide", "", "ABCD1234", "", "", "", "", "", False),
    ("course_detail", "", "ABCD1234", "", "", "", "", "", False),
    ("program", "", "WXYZ2001", "Bachelor of Science", "permit", "", "", "", False),
    ("program", "", "WXYZ2001", "", "course_to_programs", "", "", "", False),
    ("program", "", "", "Master of computer science without exam", "program_to_courses", "", "", "", False),
    ("kb", "", "", "", "", "", "", "census date", False),
    ("hybrid", "machine learning subjects in S1", "", "", "", "", "", "", False),
    ("filter", "", "", "", "", "", "", "", False),
    ("empty", "", "", "", "", "", "", "", False),
    ("semantic", "about robotics", "", "", "", "", "", "", False),
    ("empty", "", "", "", "", "", "", "", False),
    ("filter", "", "", "", "", "", "", "", False),
    ("hybrid", "biz", "", "", "", "Business School|Economics School|Music School", "", "", False),
    ("empty", "", "", "", "", "", "", "", False),
    ("empty", "", "", "", "", "", "", "", True),
    ("empty", "", "", "", "", "", "", "", False),
    ("semantic", "computer science", "", "", "", "", "", "", False),
]


def planned(spark: SparkSession, d: str) -> DataFrame:
    df = asked(spark, d, question=[q for q, _ in ASKED], draft=[x for _, x in ASKED])
    return planner.plan(df.withColumn("question", own_codes(F.col("question"))), "question", "draft", DOMAINS)


@query("nlp13_plan", own_codes_sql(stated("mode VARCHAR, semantic_query VARCHAR, course_code VARCHAR, program_name VARCHAR, direction VARCHAR, coord_units VARCHAR, ordered VARCHAR, kb_query VARCHAR, both_semesters BOOLEAN", PLANS), "course_code"))
def nlp13(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("plan")
    texts = [p[k].alias(k) for k in ("mode", "semantic_query", "course_code", "program_name", "direction", "kb_query", "both_semesters")]
    return planned(spark, d).select("p_partkey", *texts, joined(p["coord_units"]).alias("coord_units"), p["order"].alias("ordered"))


@query("nlp10_planned_slots", stated("has_exam BOOLEAN, has_hurdle BOOLEAN, level VARCHAR, units DOUBLE, location VARCHAR, semester VARCHAR, excluded VARCHAR, digits VARCHAR", [
    (False, False, "Undergraduate", None, None, None, "placement|research|thesis", None),
    *[(None,) * 8] * 4,
    (False, None, None, None, None, None, None, "3"),
    (None,) * 8,
    (None, None, None, 2.0, None, "S1", None, None),
    (None, None, None, None, "Gatton", None, None, None),
    *[(None,) * 8] * 3,
    (None, None, None, 2.0, None, None, None, None),
    (None, None, "undergraduate", None, None, None, None, None),
    *[(None,) * 8] * 4,
]))
def nlp10(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("plan")["slots"]
    plain = [s[k].alias(k) for k in ("has_exam", "has_hurdle", "level", "units", "location", "semester")]
    return planned(spark, d).select("p_partkey", *plain, joined(s["course_type_exclude"]).alias("excluded"), joined(s["code_level"]).alias("digits"))


@query("evl06_routing", "SELECT expected, count(*) AS n, count_if(expected = mode) AS ok FROM (SELECT p_partkey, mode, CASE WHEN p_partkey % 18 = 8 THEN 'hybrid' ELSE mode END AS expected FROM (" + stated("mode VARCHAR", [(p[0],) for p in PLANS]) + ")) GROUP BY expected")
def evl06(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.operators.answers import routed

    expected = F.when(F.col("p_partkey") % 18 == 8, "hybrid")
    modes = F.get(F.array(*[F.lit(p[0]) for p in PLANS]), (F.col("p_partkey") % len(PLANS)).cast("int"))
    df = routed(planned(spark, d).withColumn("expected", F.coalesce(expected, modes)), {"mode": F.col("expected")})
    return df.groupBy("expected").agg(F.count("*").alias("n"), F.count_if(F.size("failed") == 0).alias("ok"))
