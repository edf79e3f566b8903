"""Whether questions can be answered, and whether answers are as they should be. Rows are questions or answers; nothing is collected."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import planner

#: The years that the corpus covers.
YEARS = (2020, 2028)
CODE = r"(?<![A-Za-z])([A-Z]{4}[0-9]{4})(?![A-Za-z0-9])"


def words(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([a-z][a-z0-9]+)"), 1))


def gate(questions: DataFrame, found: DataFrame, vocabulary: DataFrame, years: tuple[int, int] = YEARS) -> DataFrame:
    """id, answerable and reason (ok, year or entity), with what is out of range or missing, of questions (id, question).

    An entity must be in the vocabulary (word) or in a passage found for the question (id, text). The year comes first.
    """
    asked = questions.select("id", "question", text.out_of_range_year(F.col("question"), *years).alias("_year"), text.entity_tokens(F.col("question")).alias("_entities"))
    entities = asked.select("id", F.posexplode("_entities").alias("_at", "word"))
    # Of the vocabulary and of passages only what is asked about goes on.
    known = vocabulary.select("word").join(entities.select("word").distinct(), "word", "left_semi").distinct()
    absent = entities.join(known, "word", "left_anti")
    own = found.join(entities.select("id").distinct(), "id", "left_semi").select("id", F.explode(words(F.col("text"))).alias("word"))
    said = own.join(entities.select("id", "word"), ["id", "word"], "left_semi").distinct()
    absent = absent.join(said, ["id", "word"], "left_anti").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]).alias("_absent"))
    df = asked.join(absent, "id", "left")
    reason = F.when(F.col("_year").isNotNull(), "year").when(F.col("_absent").isNotNull(), "entity").otherwise("ok")
    what = F.when(F.col("_year").isNotNull(), F.col("_year").cast("string")).otherwise(F.array_join("_absent", "|"))
    return df.select("id", (reason == "ok").alias("answerable"), reason.alias("reason"), F.coalesce(what, F.lit("")).alias("what"))


def gated(found: DataFrame, questions: DataFrame, vocabulary: DataFrame, floor: float, years: tuple[int, int] = YEARS) -> DataFrame:
    """The passages (id, text, sim) that reach the floor, of questions that can be answered; no others."""
    near = found.filter(F.col("sim") >= floor)
    ok = gate(questions.join(near.select("id").distinct(), "id", "left_semi"), near, vocabulary, years).filter("answerable")
    return near.join(ok.select("id"), "id", "left_semi")


def failures(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail; a check that is null doesn't apply."""
    return F.filter(F.array(*[F.when(~c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())


def routed(planned: DataFrame, expected: dict[str, Column], where_has: Column | None = None, where: Column | None = None) -> DataFrame:
    """planned (plan) with failed: the fields of the plan that aren't as expected; where_has: parts that the description of the slots must hold."""
    checks = {k: F.col("plan")[k].eqNullSafe(v) for k, v in expected.items()}
    if where_has is not None:
        plain = F.lower(F.replace(where, F.lit(" "), F.lit("")))
        checks["where"] = F.coalesce(F.forall(where_has, lambda x: F.contains(plain, F.lower(F.replace(x, F.lit(" "), F.lit(""))))), F.lit(True))
    return planned.withColumn("failed", failures(checks))


def leaked(answer: Column, allowed: Column, warning: str = "⚠") -> Column:
    """The codes in an answer, up to its warning line, that aren't allowed, sorted."""
    body = F.substring_index(F.coalesce(answer, F.lit("")), warning, 1)
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(body, F.lit(CODE), 1)), F.coalesce(allowed, F.array().cast("array<string>"))))


def checked(answers: DataFrame) -> DataFrame:
    """answers with failed. Columns: answer, mode, courses (codes that may be cited); and what is expected, null where it isn't: want_mode, refuse,
    refused, has and hasnt (arrays of parts), source, unsatisfied (courses that break a condition that all should meet)."""
    a = F.coalesce("answer", F.lit(""))
    cites = F.when(F.col("mode").isin("filter", "semantic", "hybrid"), F.size(leaked(F.col("answer"), F.col("courses"))) == 0)
    return answers.withColumn("failed", failures({
        "mode": F.when(F.col("want_mode").isNotNull(), F.col("mode").eqNullSafe(F.col("want_mode"))),
        "refuse": F.when(F.coalesce("refuse", F.lit(False)), F.col("refused") | (F.col("mode") == "empty")),
        "source": F.when(F.col("source").isNotNull(), F.contains(a, F.col("source"))),
        "has": F.forall("has", lambda x: F.contains(a, x)),
        "hasnt": F.forall("hasnt", lambda x: ~F.contains(a, x)),
        "satisfy": F.when(F.col("unsatisfied").isNotNull(), F.size("unsatisfied") == 0),
        "leak": cites,
    }))


def refusals(decided: DataFrame) -> DataFrame:
    """Counts over decided (label: answer or refuse, refused): questions of each kind, wrong refusals (none may be) and leaks; and whether that line holds."""
    answer = F.col("label") == "answer"
    df = decided.agg(F.count_if(answer).alias("n_answer"), F.count_if(~answer).alias("n_refuse"), F.count_if(answer & F.col("refused")).alias("wrong_refusals"), F.count_if(~answer & ~F.col("refused")).alias("leaked"))
    return df.withColumn("red_line", F.col("wrong_refusals") == 0)


def has_caveat(answer: Column) -> Column:
    """Whether an answer says that nothing matches well."""
    low = F.lower(answer)
    strong = F.contains(answer, F.lit("强相关")) & answer.rlike("未找到|未能找到|没有找到")
    return F.coalesce(answer.rlike("请自行甄别|语义最接近") | strong | F.contains(low, F.lit("strongly matching")) | F.contains(low, F.lit("closest semantic matches")), F.lit(False))


def topical(results: DataFrame, empty: Column) -> DataFrame:
    """results (expect: relevant or not, mode, answer, courses: codes, want: codes) with failed. empty: whether an answer is none."""
    caveat, a = has_caveat(F.col("answer")), F.coalesce("answer", F.lit(""))
    searched, none = F.col("mode").isin("semantic", "hybrid"), (a == "") | empty
    listed = F.coalesce(F.size("courses"), F.lit(0)) > 0
    relevant = F.col("expect") == "relevant"
    return results.withColumn("failed", failures({
        "route": F.when(relevant, searched),
        "answer": F.when(relevant, ~(none | (F.col("mode") == "empty"))),
        "caveat": F.when(relevant, ~caveat),
        "recall": F.when(relevant & (F.size("want") > 0), F.arrays_overlap("courses", "want")),
        "confident": F.when(~relevant, ~(searched & listed & ~caveat & ~none)),
    }))


def judged(scores: DataFrame, floor: int) -> DataFrame:
    """How many answers were judged, the means of relevance and faithfulness, and how many fall under the floor in either."""
    low = (F.col("relevance") < floor) | (F.col("faithfulness") < floor)
    return scores.agg(F.count("*").alias("n"), F.avg("relevance").alias("relevance"), F.avg("faithfulness").alias("faithfulness"), F.count_if(low).alias("low"))


def gold(found: DataFrame, wanted: DataFrame, question: str, key: str) -> DataFrame:
    """Of each question: precision (0 of nothing found), recall (1 of nothing wanted), exact, and violations (found and not wanted)."""
    both = found.select(question, key, F.lit(1).alias("_f")).distinct().join(wanted.select(question, key, F.lit(1).alias("_w")).distinct(), [question, key], "full")
    df = both.groupBy(question).agg(F.count_if(F.col("_f").isNotNull() & F.col("_w").isNotNull()).alias("hit"), F.count("_f").alias("nf"), F.count("_w").alias("nw"))
    ratio = lambda n, d, none: F.when(d > 0, n / d).otherwise(none)
    return df.select(question, ratio(F.col("hit"), F.col("nf"), 0.0).alias("precision"), ratio(F.col("hit"), F.col("nw"), 1.0).alias("recall"), ((F.col("hit") == F.col("nf")) & (F.col("hit") == F.col("nw"))).alias("exact"), (F.col("nf") - F.col("hit")).alias("violations"))


def normal_claim(x: Column) -> Column:
    """A claim in upper case, without punctuation at the ends, with single spaces."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), r"\s+", " "), F.lit(" 。.;;"))


def weights(items: Column, hurdles_only: bool = False) -> Column:
    """The weights of assessment items (weight, hurdle) in whole numbers (halves to even), sorted: a multiset. An item without a weight isn't in it, or, of hurdles, counts as -1."""
    own = F.filter(items, lambda a: F.coalesce(a["hurdle"], F.lit(False))) if hurdles_only else F.filter(items, lambda a: a["weight"].isNotNull())
    none = F.array().cast("array<double>")
    return F.array_sort(F.coalesce(F.transform(own, lambda a: F.bround(F.coalesce(a["weight"].cast("double"), F.lit(-1.0)), 0)), none))


def reconciled(claims: DataFrame, courses: DataFrame) -> DataFrame:
    """claims (code, prereq, items) with conflicts against courses (code, prerequisite, assessments): prereq, weights, hurdles, or missing."""
    df = claims.join(courses.withColumn("_there", F.lit(True)), "code", "left")
    same = {
        "prereq": normal_claim(F.col("prereq")) == normal_claim(F.col("prerequisite")),
        "weights": weights(F.col("items")) == weights(F.col("assessments")),
        "hurdles": weights(F.col("items"), True) == weights(F.col("assessments"), True),
    }
    return df.select(*claims.columns, F.when(F.col("_there").isNull(), F.array(F.lit("missing"))).otherwise(failures(same)).alias("conflicts"))


def modes(planned: DataFrame, searches: dict[str, DataFrame]) -> DataFrame:
    """id, mode and what the search of each question's mode has found: searches give rows (id, ...) of one schema by mode; a mode without one finds nothing."""
    parts = [planned.filter(F.col("plan")["mode"] == k).select("id", F.lit(k).alias("mode")).join(rows, "id") for k, rows in searches.items()]
    return reduce(DataFrame.unionByName, parts)


def _first_object(text: str | None) -> str | None:
    at, read = -1, json.JSONDecoder(parse_constant=lambda x: None).raw_decode
    while (at := (text or "").find("{", at + 1)) >= 0:
        try:
            return json.dumps(read(text, at)[0], ensure_ascii=False)
        except (ValueError, RecursionError):
            continue
    return None


def first_object(x: Column) -> Column:
    """The first JSON object that can be read in a text, whatever stands before and after it, as a variant; null without one. Of a key that repeats the last value counts."""
    return F.try_parse_json(F.pandas_udf(lambda xs: pd.Series([_first_object(x) for x in xs], dtype="object"), "string")(x))