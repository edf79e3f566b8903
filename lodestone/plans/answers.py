"""Queries of the answerability gate and of what is checked of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import answers, retrieval
from lodestone.plans.questions import asked, own_codes, stated
from lodestone.plans.texts import ENTITIES
from lodestone.registry import query, table

#: Questions are benchmark items with a year after them, and every fifth with a word that no document holds; what was found for one is the document of its number; the vocabulary is of all documents.
ASKED_SQL = "SELECT item_id AS id, text || CASE WHEN item_id % 5 = 0 THEN ' zyxwvut ' ELSE ' ' END || (2015 + item_id % 12)::VARCHAR AS question FROM benchmark"
GATE_SQL = f"""WITH q AS ({ASKED_SQL}), e AS (SELECT id, question, {ENTITIES.replace("lower(text)", "lower(question)")} AS ws FROM q),
    v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]+')) AS w FROM documents),
    c AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9]+')) AS said FROM documents),
    u AS (SELECT id, unnest(list_distinct(ws)) AS w FROM e),
    m AS (SELECT u.id, count(*) AS n FROM u LEFT JOIN c USING (id) WHERE w NOT IN (SELECT w FROM v) AND NOT coalesce(list_contains(said, w), false) GROUP BY 1),
    g AS (SELECT q.id, 2015 + q.id % 12 AS y, coalesce(n, 0) AS n FROM q LEFT JOIN m USING (id))"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    year = (F.col("item_id") % 12 + 2015).cast("string")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.concat("text", F.when(F.col("item_id") % 5 == 0, " zyxwvut ").otherwise(" "), year).alias("question"))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(answers.words(F.col("text"))).alias("word"))


def passages(spark: SparkSession, d: str) -> DataFrame:
    """id, text and sim (a share of 4000 characters) of the document with a question's number."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", (F.least("n_chars", F.lit(4000)) / 4000.0).alias("sim"))


@query("ans01_gate", f"{GATE_SQL} SELECT id, y BETWEEN 2020 AND 2028 AND n = 0 AS answerable, CASE WHEN y NOT BETWEEN 2020 AND 2028 THEN 'year' WHEN n > 0 THEN 'entity' ELSE 'ok' END AS reason FROM g")
def ans01(spark: SparkSession, d: str) -> DataFrame:
    return answers.gate(questions(spark, d), passages(spark, d), vocabulary(spark, d)).select("id", "answerable", "reason")


@query("kb07_gated_passages", f"{GATE_SQL} SELECT id, round(sim, 6) AS sim FROM (SELECT doc_id AS id, least(n_chars, 4000) / 4000.0::DOUBLE AS sim FROM documents) JOIN g USING (id) WHERE sim >= 0.1 AND y BETWEEN 2020 AND 2028 AND n = 0")
def kb07(spark: SparkSession, d: str) -> DataFrame:
    return answers.gated(passages(spark, d), questions(spark, d), vocabulary(spark, d), 0.1).select("id", F.round("sim", 6).alias("sim"))


ANSWERS = [
    # answer, mode, courses, want_mode, refuse, has, hasnt, source; and the checks that fail
    ("Take AAAA1000. See x.example", "filter", "AAAA1000", "filter", None, "Take|See", "Sorry", "x.example", ""),
    ("Take BBBB1000", "hybrid", "AAAA1000", "filter", None, None, None, "x.example", "mode|source|leak"),
    ("Take AAAA1000 ⚠ removed: BBBB1000", "semantic", "AAAA1000", None, None, "CCCC", "Take", None, "has|hasnt"),
    ("Here it is", "kb", None, None, "true", None, None, None, "refuse"),
    (None, "empty", None, "empty", "true", None, None, None, ""),
    ("CCCC3000 isn't cited", "program", None, None, None, None, None, None, ""),
]


@query("evl07_answers", stated("failed VARCHAR", [(x[-1],) for x in ANSWERS]).replace("CAST(v.failed AS VARCHAR) AS failed", "CASE WHEN p_size > 25 AND p_partkey % 6 = 0 THEN 'satisfy' ELSE v.failed END AS failed"))
def evl07(spark: SparkSession, d: str) -> DataFrame:
    names = ["answer", "mode", "courses", "want_mode", "refuse", "has", "hasnt", "source"]
    df = asked(spark, d, **{k: [x[i] for x in ANSWERS] for i, k in enumerate(names)}).join(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    df = df.withColumns({k: own_codes(F.col(k)) for k in ("answer", "courses", "has", "hasnt")})
    lists = {k: F.split(k, r"\|") for k in ("courses", "has", "hasnt")}
    unsatisfied = F.when(F.col("p_partkey") % 6 == 0, F.when(F.col("p_size") > 25, F.array("answer")).otherwise(F.array().cast("array<string>")))
    df = df.withColumns(lists | {"refuse": F.col("refuse").cast("boolean"), "refused": F.lit(False), "unsatisfied": unsatisfied})
    return answers.checked(df).select("p_partkey", F.array_join("failed", "|").alias("failed"))


@query("evl08_refusals", f"""{GATE_SQL} SELECT count(*) FILTER (WHERE id % 3 <> 0) AS n_answer, count(*) FILTER (WHERE id % 3 = 0) AS n_refuse, count(*) FILTER (WHERE id % 3 <> 0 AND NOT ok) AS wrong_refusals,
    count(*) FILTER (WHERE id % 3 = 0 AND ok) AS leaked, count(*) FILTER (WHERE id % 3 <> 0 AND NOT ok) = 0 AS red_line FROM (SELECT id, y BETWEEN 2020 AND 2028 AND n = 0 AS ok FROM g)""")
def evl08(spark: SparkSession, d: str) -> DataFrame:
    df = answers.gate(questions(spark, d), passages(spark, d), vocabulary(spark, d))
    return answers.refusals(df.select(F.when(F.col("id") % 3 == 0, "refuse").otherwise("answer").alias("label"), (~F.col("answerable")).alias("refused")))


TOPICS = [
    ("relevant", "semantic", "Courses: AAAA1000", "AAAA1000|BBBB1000", "BBBB1000", ""),
    ("relevant", "filter", "", "AAAA1000", "CCCC1000", "route|answer|recall"),
    ("relevant", "hybrid", "No course is strongly matching", "AAAA1000", None, "caveat"),
    ("no_strong_match", "semantic", "未找到强相关课程", "AAAA1000", None, ""),
    ("no_strong_match", "semantic", "These are courses about it", "AAAA1000", None, "confident"),
    ("no_strong_match", "kb", "These are courses about it", None, None, ""),
]


@query("evl09_topics", stated("failed VARCHAR", [(x[-1],) for x in TOPICS]))
def evl09(spark: SparkSession, d: str) -> DataFrame:
    df = asked(spark, d, **{k: [x[i] for x in TOPICS] for i, k in enumerate(["expect", "mode", "answer", "courses", "want"])})
    df = df.withColumns({k: own_codes(F.col(k)) for k in ("answer", "courses", "want")})
    df = df.withColumns({k: F.split(k, r"\|") for k in ("courses", "want")})
    return answers.topical(df, text.is_empty_answer(F.col("answer"), "no information")).select("p_partkey", F.array_join("failed", "|").alias("failed"))


@query("evl10_judged", "SELECT count(*) AS n, round(avg(l_linenumber), 6) AS relevance, round(avg(l_quantity), 6) AS faithfulness, count(*) FILTER (WHERE l_linenumber < 3 OR l_quantity < 3) AS low FROM lineitem")
def evl10(spark: SparkSession, d: str) -> DataFrame:
    df = answers.judged(table(spark, d, "lineitem").select(F.col("l_linenumber").alias("relevance"), F.col("l_quantity").alias("faithfulness")), 3)
    return df.select("n", F.round("relevance", 6).alias("relevance"), F.round("faithfulness", 6).alias("faithfulness"), "low")


@query("evl12_gold", """WITH x AS (SELECT l_suppkey AS q, l_partkey AS code, bool_or(l_returnflag = 'A') AS f, bool_or(l_linestatus = 'O' OR l_returnflag = 'A') AS w FROM lineitem GROUP BY 1, 2)
    SELECT q, coalesce(round(count(*) FILTER (WHERE f AND w) / nullif(count(*) FILTER (WHERE f), 0)::DOUBLE, 6), 0) AS precision, coalesce(round(count(*) FILTER (WHERE f AND w) / nullif(count(*) FILTER (WHERE w), 0)::DOUBLE, 6), 1) AS recall, bool_and(f = w) AS exact, count(*) FILTER (WHERE f AND NOT w) AS violations FROM x WHERE f OR w GROUP BY q""")
def evl12(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("code"), "l_returnflag", "l_linestatus")
    df = answers.gold(rows.filter("l_returnflag = 'A'"), rows.filter("l_linestatus = 'O' OR l_returnflag = 'A'"), "q", "code")
    return df.select("q", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "exact", "violations")


@query("chk01_claims", """WITH a AS (SELECT l_orderkey AS code, list_sort(list(round_even(l_quantity, 0))) AS ws, list_sort(list(round_even(l_quantity, 0)) FILTER (WHERE l_returnflag = 'R')) AS hs FROM lineitem GROUP BY 1),
    b AS (SELECT l_orderkey AS code, list_sort(list(round_even(l_quantity + CASE WHEN l_linenumber = 5 THEN 1 ELSE 0.4 END, 0))) AS ws, list_sort(list(round_even(l_quantity + CASE WHEN l_linenumber = 5 THEN 1 ELSE 0.4 END, 0)) FILTER (WHERE l_returnflag = 'R' AND l_linenumber <> 3)) AS hs FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS code, CASE WHEN a.code IS NULL THEN 'missing' ELSE array_to_string(list_filter([CASE WHEN o_orderkey % 4 = 0 THEN 'prereq' END, CASE WHEN a.ws <> b.ws THEN 'weights' END, CASE WHEN coalesce(a.hs, []) <> coalesce(b.hs, []) THEN 'hurdles' END], lambda x: x IS NOT NULL), '|') END AS conflicts
    FROM orders LEFT JOIN a ON a.code = o_orderkey LEFT JOIN b ON b.code = o_orderkey""")
def chk01(spark: SparkSession, d: str) -> DataFrame:
    """Orders as guides that claim the weights of their lines, a little off, against what the lines say."""
    hurdle = F.col("l_returnflag") == "R"
    off = F.col("l_quantity") + F.when(F.col("l_linenumber") == 5, 1.0).otherwise(0.4)
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("code")).agg(
        F.collect_list(F.struct(F.col("l_quantity").alias("weight"), hurdle.alias("hurdle"))).alias("assessments"),
        F.collect_list(F.struct(off.alias("weight"), (hurdle & (F.col("l_linenumber") != 3)).alias("hurdle"))).alias("items"),
    )
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("code"), F.when(F.col("o_orderkey") % 4 == 0, "other").otherwise("abcd1000  or\nEFGH1000 .").alias("prereq"))
    claims = claims.join(lines.select("code", "items"), "code", "left")
    courses = lines.select("code", "assessments", F.lit("ABCD1000 or EFGH1000").alias("prerequisite"))
    return answers.reconciled(claims, courses).select("code", F.array_join("conflicts", "|").alias("conflicts"))


@query("nlp15_modes", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 1 THEN 'filter' ELSE 'program' END AS mode, p_name AS found FROM part WHERE p_partkey % 3 = 1 AND p_size > 10 OR p_partkey % 3 = 2")
def nlp15(spark: SparkSession, d: str) -> DataFrame:
    """Each question is answered by the search of its mode: filter finds parts over a size, program finds all, kb finds none."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("found"), "p_size")
    mode = F.when(F.col("id") % 3 == 1, "filter").when(F.col("id") % 3 == 2, "program").otherwise("kb")
    planned = part.select("id", F.struct(mode.alias("mode")).alias("plan"))
    return answers.modes(planned, {"filter": part.filter("p_size > 10").drop("p_size"), "program": part.drop("p_size")})


@query("str26_first_object", "SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN CAST(doc_id AS VARCHAR) END AS got FROM documents")
def str26(spark: SparkSession, d: str) -> DataFrame:
    """Objects planted into documents' texts: alone, in a fence, behind a brace that opens nothing; cut off in the middle, or none."""
    k, plain = F.col("doc_id") % 5, F.translate(F.coalesce("text", F.lit("")), "{}", "")
    whole = F.concat(F.lit('{"b": {"c": [1, "}"]}, "a": '), F.col("doc_id").cast("string"), F.lit("}"))
    said = F.when(k == 0, F.concat(plain, whole, plain)).when(k == 1, F.concat(plain, F.lit("\n```json\n"), whole, F.lit("\n``` "), plain)).when(k == 2, F.concat(F.lit("{not json} "), plain, whole))
    said = said.when(k == 3, F.concat(plain, F.lit(' {"a": 1, "b": '), plain)).otherwise(plain)
    df = table(spark, d, "documents").select("doc_id", said.alias("said"))
    return df.select("doc_id", F.try_variant_get(answers.first_object(F.col("said")), "$.a", "string").alias("got"))
