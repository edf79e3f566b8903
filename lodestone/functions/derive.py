"""Columns derived from offerings: types, three-valued states, periods and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What titles and assessments say, as patterns without regard to case.
PLACEMENT, THESIS, RESEARCH, RESEARCH_WORK = r"\b(placement|internship|practicum|fieldwork)\b", r"\b(thesis|dissertation)\b", r"\bresearch\b", r"\b(project|honours|honour|capstone)\b"
MIDTERM = r"mid[\s-]*sem|mid[\s-]*term|midterm|in[\s-]*semester|in[\s-]*class"
FINAL = r"final|end[\s-]*of[\s-]*semester|end[\s-]*sem"
EXAM_TASK = r"\b(exam|quiz|test)\b"
GROUP_TASK = r"team or group-based|\bgroup\b|\bteam\b"


def _says(x: Column, pattern: str) -> Column:
    return F.coalesce(x, F.lit("")).rlike(f"(?i){pattern}")


def course_type(title: Column, assessments: Column) -> Column:
    """placement, thesis, research or coursework: the first that the title says, or (thesis) a category that is nothing else. Research needs a
    project, honours or capstone beside it: courses about research are coursework."""
    parts = lambda a: F.array_distinct(F.filter(F.transform(F.split(F.lower(a["category"]), ","), lambda x: F.trim(x)), lambda x: x != ""))
    only_thesis = F.coalesce(F.exists(assessments, lambda a: F.coalesce(parts(a) == F.array(F.lit("thesis")), F.lit(False))), F.lit(False))
    return (
        F.when(_says(title, PLACEMENT), "placement").when(_says(title, THESIS) | only_thesis, "thesis")
        .when(_says(title, RESEARCH) & _says(title, RESEARCH_WORK), "research").otherwise("coursework")
    )


def midterm_status(assessments: Column) -> Column:
    """has, none or unknown: of exams, quizzes and tests (by category or task), any in the semester; else any whose task doesn't tell when; else none."""
    items = F.filter(assessments, lambda a: F.contains(F.lower(F.coalesce(a["category"], F.lit(""))), F.lit("exam")) | _says(a["task"], EXAM_TASK))
    any_of = lambda f: F.coalesce(F.exists(items, f), F.lit(False))
    return F.when(any_of(lambda a: _says(a["task"], MIDTERM)), "has").when(any_of(lambda a: ~_says(a["task"], FINAL)), "unknown").otherwise("none")


def group_status(assessments: Column) -> Column:
    """has, none, or unknown without assessments: whether a task is a group's or team's."""
    found = F.exists(assessments, lambda a: _says(a["task"], GROUP_TASK))
    return F.when(F.coalesce(F.size(assessments), F.lit(0)) <= 0, "unknown").when(found, "has").otherwise("none")


def semester_and_year(period: Column) -> tuple[Column, Column]:
    n = F.regexp_extract(period, r"(?i)semester\s*([12])", 1)
    semester = F.when(n != "", F.concat(F.lit("S"), n)).when(F.lower(period).contains("summer"), "Summer")
    return semester, F.try_element_at(F.regexp_extract_all(period, F.lit("((?:19|20)[0-9]{2})"), 1), F.lit(1)).cast("int")


def span_at_least(begin: Column, end: Column, days: int) -> Column:
    """Whether a span has so many days; null where a date is."""
    return F.datediff(end, begin) >= days


def year_long(period: Column, days: int = 240) -> Column:
    """Whether the dates (dd/mm/yyyy - dd/mm/yyyy) of a period span so many days; null where they can't be read."""
    pattern = r"([0-9]{2}/[0-9]{2}/[0-9]{4})\s*-\s*([0-9]{2}/[0-9]{2}/[0-9]{4})"
    date = lambda k: F.try_to_date(F.nullif(F.regexp_extract(period, pattern, k), F.lit("")), "dd/MM/yyyy")
    return span_at_least(date(1), date(2), days)


def stale(checked_at: Column, today: Column, days: int = 180) -> Column:
    return F.coalesce(F.datediff(today, checked_at.try_cast("date")) > days, F.lit(False))


def slot_of(start: str, i: Column, year: int) -> Column:
    """The label of slot i of semesters that alternate from start (S1 or S2) of a year."""
    at = i + (0 if start == "S1" else 1)
    return F.concat(F.when(at % 2 == 0, F.lit("S1 ")).otherwise(F.lit("S2 ")), (F.floor(at / 2) + year).cast("string"))


def slots_needed(units: Column, last_placed: Column, cap: float = 8.0) -> Column:
    return F.greatest(F.lit(1), F.ceil(units / cap), F.coalesce(last_placed, F.lit(-1)) + 1).cast("int")
