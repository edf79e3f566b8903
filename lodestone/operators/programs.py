"""Program pages' embedded JSON: rules with what they list, auxiliary rules with their kind, and the program's formula.

Objects are brought out of the text a row each, in the order of the page; all that follows is expressions and joins.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE = r"^[A-Z]{4}[0-9]{4}"
PARAMS = "array<struct<name string, value variant>>"
_TEXT = json.JSONEncoder(ensure_ascii=False).encode


def _objects(x: dict | list, path: str, out: list[tuple[str, dict]]) -> list[tuple[str, dict]]:
    """The objects in x with their paths, each before those in it."""
    if isinstance(x, dict):
        out.append((path, x))
        for k, v in x.items():
            if isinstance(v, (dict, list)):
                _objects(v, f"{path}/{k}", out)
    elif isinstance(x, list):
        for i, v in enumerate(x):
            if isinstance(v, (dict, list)):
                _objects(v, f"{path}/{i:04d}", out)
    return out


def objects(pages: DataFrame, id_column: str, text: str, having: tuple[str, ...] = ()) -> DataFrame:
    """id, at (the place in the page), path and node (variant) of every object in a column of JSON text, or of those that have some keys; a text that can't be read has none."""
    wanted = set(having)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, raw in zip(pdf["id"], pdf["json"], strict=True):
                try:
                    top = json.loads(raw or "")
                except ValueError:
                    continue
                rows += [(key, i, path, _TEXT(node)) for i, (path, node) in enumerate(_objects(top, "", [])) if wanted <= node.keys()]
            yield pd.DataFrame(rows, columns=["id", "at", "path", "node"])

    df = pages.select(F.col(id_column).cast("string").alias("id"), F.col(text).alias("json")).mapInPandas(walk, "id string, at int, path string, node string")
    return df.withColumn("node", F.parse_json("node"))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def _is(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(_get(v, path, "variant")), F.lit("")).startswith(kind)


def _param_text(value: Column) -> Column:
    """What a parameter shows: a code, a plan's name and subtype, a name, or the value itself; lists with their parts joined."""
    kind = F.schema_of_variant(value)

    def one(v: Column) -> Column:
        plan = F.trim(F.concat(_squeezed(_get(v, "$.plan.name")), F.lit(" "), F.coalesce(_get(v, "$.plan.subtype"), F.lit(""))))
        shown = F.coalesce(F.nullif(_get(v, "$.code"), F.lit("")), F.nullif(plan, F.lit("")), _squeezed(_get(v, "$.name")))
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), shown).otherwise(v.cast("string"))

    listed = F.array_join(F.filter(F.transform(value.try_cast("array<variant>"), one), lambda x: x != ""), "、")
    return F.when(kind.startswith("ARRAY"), listed).otherwise(one(value))


def _param_codes(value: Column) -> Column:
    parts = F.when(F.schema_of_variant(value).startswith("ARRAY"), value.try_cast("array<variant>")).otherwise(F.array(value))
    return F.filter(F.transform(parts, lambda v: _get(v, "$.code")), lambda x: x.isNotNull() & (x != ""))


def _filled(text: Column, params: Column) -> Column:
    """A text with each [NAME] of its parameters (name, value: text) filled in."""
    none = F.array().cast("array<struct<name: string, value: string>>")
    return F.aggregate(F.coalesce(params, none), text, lambda t, p: F.replace(t, F.concat(F.lit("["), p["name"], F.lit("]")), F.coalesce(p["value"], F.lit(""))))


def rules(nodes: DataFrame) -> DataFrame:
    """id, at, path, ref, title, rule_text, units_min, units_max, select_type, rule_logic, children (refs) and items (kind, codes) of the objects
    with a header and a body; one that lists nothing stays if it has a reference and a formula or a selection rule."""
    n, header = F.col("node"), "$.header"
    df = nodes.filter(_is(n, header, "OBJECT") & _is(n, "$.body", "ARRAY"))
    params = F.coalesce(_get(n, f"{header}.selectionRule.params", PARAMS), _get(n, f"{header}.params", PARAMS))
    shown = F.transform(params, lambda p: F.struct(p["name"].alias("name"), p["value"].cast("string").alias("value")))
    said = F.coalesce(F.nullif(_get(n, f"{header}.selectionRule.text"), F.lit("")), _get(n, f"{header}.text"))
    value = lambda k: F.get(F.filter(shown, lambda p: p["name"] == k), F.lit(0))["value"]
    body = _get(n, "$.body", "array<variant>")

    none = F.array().cast("array<string>")

    def read(x: Column) -> Column:
        options = F.filter(F.transform(_get(x, "$.equivalenceGroup", "array<variant>"), lambda o: _get(o, "$.curriculumReference.code")), lambda c: c.isNotNull() & (c != ""))
        return F.struct(_get(x, "$.rowType").alias("row"), F.coalesce(_get(x, "$.curriculumReference.code"), F.lit("")).alias("code"), options.alias("options"))

    def item(x: Column) -> Column:
        row, code, options = x["row"], x["code"], x["options"]
        kind = (
            F.when((row == "CurriculumReference") & code.rlike(CODE), "course").when((row == "CurriculumReference") & (code != ""), "plan")
            .when((row == "EquivalenceGroup") & (F.size(options) > 0), "equivalence").when(row == "WildCardItem", "wildcard")
        )
        return F.struct(kind.alias("kind"), F.when(row == "CurriculumReference", F.array(code)).when(row == "EquivalenceGroup", options).otherwise(none).alias("codes"))

    refs = F.filter(F.transform(body, lambda b: _get(b, "$.header.partReference")), lambda x: x.isNotNull() & (x != ""))
    out = df.select(
        "id", "at", "path", _get(n, f"{header}.partReference").alias("ref"), _squeezed(_get(n, f"{header}.title")).alias("title"), _filled(_squeezed(said), shown).alias("rule_text"),
        F.coalesce(value("N"), _get(n, f"{header}.unitsMin"), _get(n, f"{header}.unitsMinimum")).alias("units_min"), F.coalesce(value("M"), _get(n, f"{header}.unitsMax"), _get(n, f"{header}.unitsMaximum")).alias("units_max"),
        F.when(F.contains(_squeezed(said), F.lit("ALL of the following")), "all").otherwise("select").alias("select_type"), F.nullif(_squeezed(_get(n, f"{header}.ruleLogic")), F.lit("")).alias("rule_logic"),
        refs.alias("children"), F.filter(F.transform(F.transform(body, read), item), lambda x: x["kind"].isNotNull()).alias("items"), _is(n, f"{header}.selectionRule", "OBJECT").alias("_selects"),
    )
    return out.filter((F.size("items") > 0) | (F.col("ref").isNotNull() & (F.col("rule_logic").isNotNull() | F.col("_selects")))).drop("_selects")


def _codes(items: Column, kinds: list[str]) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(items, lambda x: x["kind"].isin(*kinds)), lambda x: x["codes"]))))


def rule_codes(found: DataFrame) -> DataFrame:
    """id, path, ref, and each rule's codes: enumerated (its courses and all options), plans, and below (its own and those of the rules inside it)."""
    own = found.filter("id IS NOT NULL").select("id", "path", "ref", _codes(F.col("items"), ["course", "equivalence"]).alias("enumerated"), _codes(F.col("items"), ["plan"]).alias("plans"))
    of_page = own.groupBy("id").agg(F.collect_list(F.struct("path", "ref", "enumerated", "plans")).alias("_all"))
    inside = lambda x: F.filter("_all", lambda y: F.startswith(F.concat(y["path"], F.lit("/")), F.concat(x["path"], F.lit("/"))))
    below = lambda x: F.array_sort(F.array_distinct(F.flatten(F.transform(inside(x), lambda y: y["enumerated"]))))
    rows = of_page.select("id", F.explode(F.transform("_all", lambda x: F.struct(x["path"], x["ref"], x["enumerated"], x["plans"], below(x).alias("below")))).alias("_x"))
    return rows.select("id", *[F.col(f"_x.{k}") for k in ("path", "ref", "enumerated", "plans", "below")])


def auxiliary(nodes: DataFrame) -> DataFrame:
    """id, at, type, text and exclude_codes of the rules in all lists auxiliaryRules, in the order of the page."""
    df = nodes.select("id", "at", F.posexplode(_get(F.col("node"), "$.auxiliaryRules", "array<variant>")).alias("n", "a"))
    params = _get(F.col("a"), "$.params", PARAMS)
    shown = F.transform(params, lambda p: F.struct(p["name"].alias("name"), _param_text(p["value"]).alias("value")))
    df = df.select("id", "at", "n", _filled(F.coalesce(_get(F.col("a"), "$.text"), F.lit("")), shown).alias("_t"), F.coalesce(F.flatten(F.transform(params, lambda p: _param_codes(p["value"]))), F.array().cast("array<string>")).alias("_c"))
    low, has = F.lower("_t"), lambda *xs: F.lower("_t").rlike("|".join(xs))
    conditional = has("completing", "for a student", "for students", "can only be counted", "can not be undertaken")
    kind = (
        F.when(low.startswith("no credit will be given for") & ~conditional, "exclude").when(has("no credit"), "exclude_conditional").when(has("at most", "at least"), "level_cap")
        .when(has("can not be undertaken"), "plan_conflict").when(has("can only be counted"), "plan_scoped").when(has("discipline"), "discipline_cap").otherwise("other")
    )
    codes = F.when(kind == "exclude", F.array_sort(F.array_distinct("_c"))).otherwise(F.array().cast("array<string>"))
    return df.select("id", F.struct("at", "n").alias("at"), kind.alias("type"), _squeezed(F.col("_t")).alias("text"), codes.alias("exclude_codes"))


def excluded(aux: DataFrame) -> DataFrame:
    """The distinct program_id and course_code of rules that exclude."""
    return aux.filter("type = 'exclude'").select(F.col("id").alias("program_id"), F.explode("exclude_codes").alias("course_code")).distinct()


def formulas(nodes: DataFrame) -> DataFrame:
    """id and formula: the formulas on objects without a reference that name a part, in the order of the page, more than one in brackets joined by AND."""
    logic = _get(F.col("node"), "$.ruleLogic")
    found = nodes.filter(F.contains(logic, F.lit("Part")) & (F.coalesce(_get(F.col("node"), "$.partReference"), F.lit("")) == "")).select("id", "at", _squeezed(logic).alias("f"))
    parts = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "f"))), lambda x: x["f"]).alias("fs"))
    joined = F.array_join(F.transform("fs", lambda f: F.concat(F.lit("( "), f, F.lit(" )"))), " AND ")
    return parts.select("id", F.when(F.size("fs") > 1, joined).otherwise(F.get("fs", F.lit(0))).alias("formula"))
