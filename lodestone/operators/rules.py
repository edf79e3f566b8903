"""Rules of study plans: prerequisite and formula trees, schedules and the assignment of courses to bins.

A plan is small and its steps depend on each other, so the helpers here are plain functions of one plan; schedules() and assignments()
run them on a row for each plan, so that plans spread over the tasks.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.files import cut

#: Turns in which pairs of courses meet the prerequisites.
SLICES = 3
CODE = re.compile(r"[A-Z]{4}[0-9]{4}\b")
_PREFIXED = re.compile(r"\b([A-Z]{4})?([0-9]{4})\b")


def expand_codes(text: str) -> str:
    """Numbers without letters take those of the code before them."""
    last = ""

    def full(m: re.Match) -> str:
        nonlocal last
        last = m[1] or last
        return f"{last}{m[2]}"

    return _PREFIXED.sub(full, text)


def _grammar(tokens: list[str]) -> dict | None:
    """The tree of a sequence of operands, "and", "or" and brackets, or looser than and; None if it isn't well-formed."""
    groups: list[list[list]] = [[[]]]  # open brackets > alternatives > members
    need_operand = True
    fold = lambda op, xs: xs[0] if len(xs) == 1 else {"op": op, "of": xs}
    close = lambda g: fold("or", [fold("and", xs) for xs in g])
    for t in tokens:
        if t == "(" and need_operand:
            groups.append([[]])
        elif t in ("and", "or") and not need_operand:
            need_operand = True
            if t == "or":
                groups[-1].append([])
        elif t == ")" and not need_operand and len(groups) > 1:
            done = close(groups.pop())
            groups[-1][-1].append(done)
        elif t not in ("(", ")", "and", "or") and need_operand:
            groups[-1][-1].append({"op": "is", "of": t})
            need_operand = False
        else:
            return None
    return None if need_operand or len(groups) > 1 else close(groups[0])


def parse_prerequisite(text: str | None) -> dict | None:
    """None for nothing; a tree of codes; {"op": "raw"} where a word can't be understood."""
    if not (text or "").strip():
        return None
    plain = re.sub(r"[+&,]", " and ", expand_codes(text.strip().rstrip(".")))
    tokens = [t.lower() if t.lower() in ("and", "or") else t for t in re.findall(r"[()]|[^\s()]+", plain)]
    known = all(t in ("(", ")", "and", "or") or CODE.fullmatch(t) for t in tokens)
    return (_grammar(tokens) if known else None) or {"op": "raw", "of": text.strip()}


def parse_formula(text: str | None) -> dict | None:
    """The tree of "Part A AND (Part B OR Part C)", or None where all parts are to be met."""
    tokens = re.findall(r"[()]|\bAND\b|\bOR\b|Part\s+[\w.]+|\S+", text or "")
    if not tokens or any(t not in ("(", ")", "AND", "OR") and not t.startswith("Part") for t in tokens):
        return None
    return _grammar([t.lower() if t in ("AND", "OR") else t for t in tokens])


def satisfied(tree: dict | None, have: set[str]) -> tuple[bool, str | None]:
    """Whether a tree holds, and a warning where it couldn't be checked, or what is missing."""
    if tree is None:
        return True, None
    if tree["op"] == "raw":
        return True, f"check: {tree['of']}"
    if tree["op"] == "is":
        return tree["of"] in have, None if tree["of"] in have else tree["of"]
    results = [satisfied(x, have) for x in tree["of"]]
    ok = all(r for r, _ in results) if tree["op"] == "and" else any(r for r, _ in results)
    said = [s for r, s in results if s and not r]
    return ok, None if ok else (" and " if tree["op"] == "and" else " or ").join(said)


def codes_of(tree: dict | None) -> set[str]:
    if tree is None or tree["op"] == "raw":
        return set()
    return {tree["of"]} if tree["op"] == "is" else set().union(*map(codes_of, tree["of"]))


def _json(tree: dict | None) -> str | None:
    return None if tree is None else json.dumps(tree, ensure_ascii=False)


def expanded_codes(text: Column) -> Column:
    return F.pandas_udf(lambda xs: pd.Series([expand_codes(x or "") for x in xs], dtype="object"), "string")(text)


def prerequisite_trees(text: Column) -> Column:
    """The trees of prerequisites, as JSON."""
    return F.pandas_udf(lambda xs: pd.Series([_json(parse_prerequisite(x)) for x in xs], dtype="object"), "string")(text)


def formula_trees(text: Column) -> Column:
    return F.pandas_udf(lambda xs: pd.Series([_json(parse_formula(x)) for x in xs], dtype="object"), "string")(text)


def satisfactions(text: Column, have: Column) -> Column:
    """ok and said of prerequisites, given the codes that one has."""

    def check(xs: pd.Series, codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([satisfied(parse_prerequisite(x), set(c)) for x, c in zip(xs, codes, strict=True)], columns=["ok", "said"]).astype({"said": "object"})

    return F.pandas_udf(check, "ok boolean, said string")(text, have)


def levels(codes: list[str], trees: dict[str, dict | None]) -> dict[str, int]:
    """The length of the longest chain of prerequisites within the plan before each code; codes on a cycle have none."""
    needs = {c: codes_of(trees.get(c)) & set(codes) - {c} for c in codes}
    out: dict[str, int] = {}
    while ready := [c for c in needs if c not in out and needs[c] <= out.keys()]:
        out |= {c: 1 + max((out[p] for p in needs[c]), default=-1) for c in ready}
    return out


def schedule(codes: list[str], trees: dict, offered: dict[str, set], units: dict[str, float], cap: float, n_slots: int | None, start: str = "S1", year_long: frozenset = frozenset(), clashes: dict | None = None) -> dict:
    """Greedy first fit: by level, then larger units, then code; a code goes into the first slot that it is offered in, that has room
    and whose earlier slots satisfy its prerequisite. Year-long codes take half of their units in each of two slots that follow.
    Without n_slots there are as many as the codes take."""
    codes = list(dict.fromkeys(codes))
    if n_slots is None:  # a code that fits anywhere fits into one of the three slots that follow those taken
        n_slots = 3 * len(codes)
    kind = lambda i: ("S1", "S2")[(i + (start != "S1")) % 2]
    level = levels(codes, trees)
    load, place, problems = [0.0] * n_slots, {}, []
    problems += [f"incompatible: {a} {b}" for a in codes for b in sorted((clashes or {}).get(a, ())) if b in codes and a < b]
    problems += [f"cycle: {c}" for c in codes if c not in level]
    for c in sorted(level, key=lambda c: (level[c], -units.get(c, 2.0), c)):
        spread = 2 if c in year_long else 1
        u = units.get(c, 2.0) / spread
        for i in range(n_slots - spread + 1):
            fits = all(load[i + k] + u <= cap for k in range(spread)) and (kind(i) == "S1" if spread == 2 else kind(i) in offered.get(c, {"S1", "S2"}))
            outside = codes_of(trees.get(c)) - set(codes)
            if fits and satisfied(trees.get(c), {p for p, s in place.items() if s < i} | outside)[0]:
                place[c] = i + spread - 1
                for k in range(spread):
                    load[i + k] += u
                break
        else:
            problems.append(f"no slot: {c}")
    return {"place": place, "load": load, "problems": problems}


def assign(bins: list[dict], units: dict[str, float]) -> dict[str, int]:
    """code -> bin, so that bins (codes, need, cap) reach what they need: tight bins first, and a bin may take a code from one that
    can refill or spare it. What is left goes wherever room is, at last into its first bin beyond the cap."""
    where: dict[str, int] = {}
    options = defaultdict(list)
    for i, b in enumerate(bins):
        for c in b["codes"]:
            if c in units:
                options[c].append(i)
    have = lambda i: sum(units[c] for c, j in where.items() if j == i)
    by_units = sorted(options, key=lambda c: (-units[c], c))

    def reach(i: int, seen: frozenset) -> bool:
        """Give bin i one more code, maybe from a bin that gets another in its place."""
        for c in by_units:
            if i not in options[c] or where.get(c) == i or have(i) + units[c] > bins[i]["cap"]:
                continue
            donor = where.get(c)
            if donor is None:
                where[c] = i
                return True
            if donor in seen:
                continue
            where[c] = i
            if have(donor) >= bins[donor]["need"] or reach(donor, seen | {i}):
                return True
            where[c] = donor
        return False

    offered = lambda i: sum(units[c] for c in options if i in options[c])
    for i in sorted(range(len(bins)), key=lambda i: offered(i) - bins[i]["need"]):
        while have(i) < bins[i]["need"] and reach(i, frozenset([i])):
            pass
    for c in by_units:
        if c not in where:
            room = [i for i in options[c] if have(i) + units[c] <= bins[i]["cap"]]
            where[c] = (room or options[c])[0]
    return where


def _plans(plans: DataFrame, *columns: str) -> DataFrame:
    """A row a plan, with its courses in order of code. A plan's size is that of a course of study."""
    return plans.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("code", *columns))).alias("courses"))


def schedules(plans: DataFrame, cap: float = 8.0, n_slots: int | None = 8) -> DataFrame:
    """plan_id, code, slot and problem of plans (plan_id, code, units, prerequisite, offered: array); without n_slots a plan has as many as it takes."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for plan_id, courses in zip(pdf["plan_id"], pdf["courses"], strict=True):
                trees = {c["code"]: parse_prerequisite(c["prerequisite"]) for c in courses}
                got = schedule([c["code"] for c in courses], trees, {c["code"]: set(c["offered"]) for c in courses}, {c["code"]: c["units"] for c in courses}, cap, n_slots)
                rows += [(plan_id, c, i, None) for c, i in sorted(got["place"].items())] + [(plan_id, None, None, p) for p in got["problems"]]
            yield pd.DataFrame(rows, columns=["plan_id", "code", "slot", "problem"]).astype({"slot": "Int32", "code": "object", "problem": "object"})

    return _plans(plans, "units", "prerequisite", "offered").mapInPandas(place, "plan_id long, code string, slot int, problem string")


def assignments(plans: DataFrame) -> DataFrame:
    """plan_id, code and bin of plans (plan_id, code, units, bins: JSON list of codes, need and cap, the same in all rows of a plan)."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, c, i) for p, courses in zip(pdf["plan_id"], pdf["courses"], strict=True) for c, i in sorted(assign(json.loads(courses[0]["bins"]), {x["code"]: x["units"] for x in courses}).items())]
            yield pd.DataFrame(rows, columns=["plan_id", "code", "bin"])

    return _plans(plans, "units", "bins").mapInPandas(place, "plan_id long, code string, bin int")


def rule_status(assigned: DataFrame, rules: DataFrame) -> DataFrame:
    """plan_id, bin, done, counted (not over the cap), over and met of rules (plan_id, bin, need, cap), from assigned rows with units."""
    done = assigned.groupBy("plan_id", "bin").agg(F.sum("units").alias("done"))
    df = rules.join(done, ["plan_id", "bin"], "left").withColumn("done", F.coalesce("done", F.lit(0.0)))
    return df.select("plan_id", "bin", "done", F.least("done", "cap").alias("counted"), (F.col("done") > F.col("cap")).alias("over"), (F.col("done") >= F.col("need")).alias("met"))


def overall(status: DataFrame) -> DataFrame:
    return status.groupBy("plan_id").agg(F.sum("counted").alias("counted"), F.bool_and("met").alias("complete"))


def timetable_problems(placed: DataFrame, prerequisites: DataFrame, cap: float) -> DataFrame:
    """plan_id, problem and code of placed rows (plan_id, code, slot, units, offered) against prerequisites (code, needs).

    Courses meet within their plan, not over all plans that have one of them, and the pairs of which one may be needed by the other meet the prerequisites in SLICES turns, so that
    only so large a part of them is shuffled at a time.
    """
    kind = F.when(F.col("slot") % 2 == 0, "S1").otherwise("S2")
    course = F.struct("code", "slot", F.col("units").cast("double").alias("units"), (~F.array_contains("offered", kind)).alias("out"))
    of_plan = cut(placed.select("plan_id", course.alias("x")).groupBy("plan_id").agg(F.collect_list("x").alias("xs")), "timetable-plans")
    wanted = cut(prerequisites.select("code", "needs"), "timetable-needs")

    one = of_plan.select("plan_id", "xs", F.explode("xs").alias("x"))
    not_offered = one.filter("x.out").select("plan_id", F.lit("not offered").alias("problem"), "x.code")
    slots = of_plan.select("plan_id", "xs", F.explode(F.array_distinct(F.transform("xs", lambda x: x["slot"]))).alias("slot"))
    load = F.aggregate(F.filter("xs", lambda y: y["slot"].eqNullSafe(F.col("slot"))), F.lit(0.0), lambda s, y: s + F.coalesce(y["units"], F.lit(0.0)))
    over = slots.filter(load > cap).select("plan_id", F.lit("over cap").alias("problem"), F.col("slot").cast("string").alias("code"))

    own = not wanted.filter("code = needs").isEmpty()
    pairs = one.filter("plan_id IS NOT NULL").select("plan_id", "x", F.explode("xs").alias("y")).filter((F.col("y.slot") >= F.col("x.slot")) & (F.lit(own) | (F.col("y.code") != F.col("x.code"))))
    pairs = pairs.select("plan_id", F.col("x.code").alias("code"), F.col("y.code").alias("needs"))
    found = not_offered.unionByName(over)
    for turn in range(SLICES):
        now = F.pmod(F.xxhash64("code", "needs"), F.lit(SLICES)) == turn
        late = pairs.filter(now).join(wanted.filter(now), ["code", "needs"]).select("plan_id", F.lit("prerequisite later").alias("problem"), "code")
        found = found.unionByName(cut(late, "timetable-late"))
    return found
