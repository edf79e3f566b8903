"""From a question to a plan: slots that a draft proposes and the text confirms, intents, routes. All in expressions of columns.

The draft (JSON text, say of a language model) is a column of the caller's; without one the plan is the text's alone. Domains, the
values that the catalogue holds for a few columns of low cardinality, are short lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a question says, as patterns without regard to case.
CODE = r"(?<![A-Za-z])([A-Za-z]{4}\d{4})(?![A-Za-z0-9])"
DEGREE = r"(bachelors?\s+of|masters?\s+of|diploma|graduate\s+certificate|graduate\s+diploma|doctors?\s+of|学士|硕士|博士|本科专业|研究生专业|文凭)"
DEGREE_NAME = r"((?:bachelors?|masters?|graduate\s+diploma|graduate\s+certificate|diploma|doctor)\s+(?:of\s+)?[A-Za-z][A-Za-z /&()'\-]*)"
UNITS = r"(\d+(?:\.\d+)?)\s*(?:学分|units?)"
REQUIRED = r"核心课|核心|必修|选修|compulsory|(?<![A-Za-z])core(?![A-Za-z])|(?<![A-Za-z])elective(?![A-Za-z])|要修哪些|有哪些课|哪些课|培养方案|课表"
RELATED = r"专业|program|major|主修|培养方案|必修|选修|核心"
PERMITTED = r"能修|能不能|可以修|可不可以|不能修|禁修|不可修|can\s+(?:i\s+)?take|allowed to take"
LEVELS = [
    (r"研究生|postgraduate|post-graduate", "Postgraduate Coursework"),
    (r"本科生?|undergraduate|under-graduate", "Undergraduate"),
    (r"硕士|(?<![A-Za-z])masters?(?![A-Za-z])(?!\s+of)", "Postgraduate Coursework"),
    (r"学士|(?<![A-Za-z])bachelors?(?![A-Za-z])(?!\s+of)", "Undergraduate"),
]
SEMESTER_1 = r"(?<![A-Za-z])s1(?![A-Za-z])|第一学期|学期一|semester\s*1|sem\s*1"
SEMESTER_2 = r"(?<![A-Za-z])s2(?![A-Za-z])|第二学期|学期二|semester\s*2|sem\s*2"
BOTH = r"都|两个?学期|每(?:个|学期)|both"
FIRST_DIGITS = [
    r"([1-9](?:\s*[或和、,/]\s*[1-9])*)\s*(?:开头|字头|打头|字班|年级)",
    r"(?:开头|字头|打头|首位|起始)\s*(?:数字)?\s*(?:为|是|=|:|:)?\s*([1-9](?:\s*[或和、,/]\s*[1-9])*)",
    r"start(?:s|ing)?\s+with\s+([1-9](?:\s*(?:or|and|,)\s*[1-9])*)",
    r"([1-9])xxx",
]
EASY = r"躺平|水课|划水|好过|容易过|考核少|作业少|考试少|负担轻|轻松.{0,3}课|课.{0,3}轻松|(?:assessment|考核|考评|评估)\s*(?:组成|构成|结构|安排)?\s*(?:最)?简单"
NO = r"(没有?|无|不|without|no)\s*"
WITH = r"(有|要|含|with)\s*"
EXAM = r"(期末|期终|final\s*)?(考试|exam)"
GROUP = r"(?:小组|团队|group\s*work|group\s*project|group\s*assessment|groupwork|\bgroup\b|\bteam\b)"
EXCLUDING = r"排除|不含|不包括|不要|除去|去掉|剔除|except|exclud|without"
TYPES = [(r"thesis|论文", "thesis"), (r"research|研究(?!生)", "research"), (r"placement|实习|practicum|internship", "placement")]
TITLES = [
    (r"capstone|顶点", ["capstone"]),
    (r"literature\s+review|文献\s*综述", ["literature review"]),
    (r"(?<![A-Za-z])review(?![A-Za-z])|综述", ["review"]),
    (r"(?<![A-Za-z])project(?![A-Za-z])|项目|课程?设计", ["project"]),
    (r"proposal|开题", ["proposal"]),
    (r"dissertation|学位论文", ["dissertation"]),
    (r"(?<![A-Za-z])thesis(?![A-Za-z])|毕业论文", ["thesis"]),
    (r"(?<![A-Za-z])research(?![A-Za-z])|研究(?!生)", ["research"]),
    (r"industry\s+placement|placement|实习|internship|practicum|实训", ["placement", "internship", "practicum"]),
]
FACULTIES = [
    (r"商科|商学院?|business|commerce|econ(?:omic)?", ["Business School", "Economics School"]),
    (
        r"文科|人文|humanities|liberal\s*arts|(?<![A-Za-z])arts(?![A-Za-z])",
        ["Communication & Arts School", "Languages & Cultures School", "Historical & Philosophical Inq", "Music School", "Humanities, Arts and Social Sciences", "Politic Sc & Internat Studies"],
    ),
]
GUIDE = r"难不难|好过吗|水不水|怎么样|体验|值不值|踩坑|避坑|怎么准备|给点建议|经验|攻略|心得"
FACT = (
    r"什么时候|何时|哪天|几号|日期|开学|开课|放假|截止|先修|先决|前置|前导|修读要求|考核|考评|评估|评分|成绩构成|占比|权重|考试|学分|"
    r"\b(?:census|deadline|when|start\s*date|prerequisite|prereq|exam|assessment|weight|hurdle|units?)\b"
)
TOPIC = (
    r"(相关|有关|关于|方向|领域|主题|about|related|topic|计算机|软件|人工智能|机器学习|深度学习|数据|网络安全|信息安全|金融|会计|经济|"
    r"心理|生物|化学|物理|数学|统计|电子|电气|通信|机械|土木|商科|管理|市场|营销|写作|护理|艺术|法律|医学|教育|建筑|环境|机器人|"
    r"(?<![A-Za-z])(cs|ai|ml|it|ee)(?![A-Za-z])|computer|software|machine[\s-]*learning|data|security|finance|account|psycholog|biolog|chemis|physic|statistic|"
    r"electric|mechanic|civil|business|market|writing|nursing|\bart\b|\blaw\b|medic|education|architect|environment|robotic|engineer)"
)
ABBREVIATIONS = [("cs", "computer science"), ("ai", "artificial intelligence"), ("ml", "machine learning"), ("it", "information technology"), ("ee", "electrical engineering")]
CAMPUSES = [
    ("st lucia", "St Lucia"), ("stlucia", "St Lucia"), ("圣卢西亚", "St Lucia"), ("gatton", "Gatton"), ("加顿", "Gatton"), ("herston", "Herston"), ("赫斯顿", "Herston"), ("dutton park", "Dutton Park"),
    ("duttonpark", "Dutton Park"), ("pace", "PACE"), ("translational research institute", "Translational Research Institute"), ("external", "External"), ("online", "Online"),
]
ATTENDANCE = [
    ("in person", "In Person"), ("in-person", "In Person"), ("面授", "In Person"), ("线下", "In Person"), ("online", "Online"), ("线上", "Online"), ("网课", "Online"), ("external", "External"),
    ("远程", "External"), ("函授", "External"),
]
MODES = ["filter", "semantic", "hybrid", "program", "kb", "course_detail", "guide"]
DIRECTIONS = ["course_to_programs", "program_to_courses", "permit"]
STATES = ["has", "none", "unknown"]
COURSE_TYPES = ["coursework", "placement", "research", "thesis"]
DETAILS = [
    ("prereq", r"先修|先决|前置|前导|修读要求|prerequisite|prereq"),
    ("assessment", r"考核|考评|评估|评分|成绩构成|怎么考|如何考|考试|占比|assessment"),
    ("units", r"学分|几分|多少分|units"),
    ("semester", r"开课|哪个学期|什么时候开|第几学期|何时开|开设|semester"),
]
ASSESSMENT_TYPES = [
    ("presentation", r"presentation|demonstration|演讲|展示|汇报"), ("quiz", r"quiz|测验|小测"), ("essay", r"essay|论文|小论文"), ("report", r"report|报告"), ("project", r"project|项目"),
    ("poster", r"poster|海报"), ("portfolio", r"portfolio|作品集"), ("participation", r"participation|参与|出勤"), ("reflection", r"reflection|reflective|反思"),
]

SLOTS = ["has_exam", "has_hurdle", "midterm_status", "group_status", "level", "units", "location", "attendance_mode", "semester", "course_type_exclude", "course_type_only", "code_level"]


def _none() -> Column:
    return F.lit(None).cast("string")


def says(q: Column, pattern: str) -> Column:
    return q.rlike(f"(?i){pattern}")


def first(q: Column, pairs: list[tuple[str, str]]) -> Column:
    """The value of the first pattern that stands in the question, else null."""
    return reduce(lambda out, x: out.when(says(q, x[0]), x[1]), pairs, F).otherwise(_none())


def every(q: Column, pairs: list[tuple[str, object]]) -> Column:
    """The distinct values of all patterns that stand in the question, in their order; a value may be a list."""
    none = F.array().cast("array<string>")
    lists = [F.when(says(q, p), F.array(*map(F.lit, v if isinstance(v, list) else [v]))).otherwise(none) for p, v in pairs]
    return F.array_distinct(F.concat(*lists))


def _literal(key: str) -> str:
    return rf"(?<![A-Za-z]){key}(?![A-Za-z])" if key.isascii() else key


def exam_intent(q: Column) -> Column:
    """False where an exam is negated, true where it is asked for, else null."""
    return F.when(says(q, NO + EXAM), False).when(says(q, WITH + EXAM), True)


def group_intent(q: Column) -> Column:
    return F.when(says(q, NO + GROUP), False).when(says(q, WITH + GROUP), True)


def excluded_types(q: Column) -> Column:
    return F.when(says(q, EXCLUDING), F.array_sort(every(q, TYPES))).otherwise(F.array().cast("array<string>"))


def excluded_titles(q: Column) -> Column:
    return F.when(says(q, EXCLUDING), every(q, TITLES)).otherwise(F.array().cast("array<string>"))


def first_digits(q: Column) -> Column:
    """First digits of codes that are asked for, distinct and ascending."""
    found = F.flatten(F.array(*[F.regexp_extract_all(q, F.lit(f"(?i){p}"), 1) for p in FIRST_DIGITS]))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda x: F.regexp_extract_all(x, F.lit("([1-9])"), 1)))))


def both_semesters(q: Column) -> Column:
    return says(q, SEMESTER_1) & says(q, SEMESTER_2) & says(q, BOTH)


def faculty_units(q: Column) -> Column:
    return every(q, FACULTIES)


def level_hint(q: Column) -> Column:
    return first(q, LEVELS)


def asked_campus(q: Column) -> Column:
    return first(q, [(_literal(k), v) for k, v in CAMPUSES])


def asked_attendance(q: Column) -> Column:
    return first(q, [(_literal(k), v) for k, v in ATTENDANCE])


def guarded(draft: Column, asked: Column, domain: list[str]) -> Column:
    """What was asked for fills a missing value; a value that the domain lacks replaces any other, so that the result is rightly empty."""
    known = F.lower(asked).isin(*[x.lower() for x in domain]) if domain else F.lit(False)
    return F.when(asked.isNull(), draft).when(known, F.coalesce(draft, asked)).otherwise(asked)


def expanded(name: Column) -> Column:
    for short, full in ABBREVIATIONS:
        name = F.regexp_replace(name, rf"(?i)(?<![A-Za-z]){short}(?![A-Za-z])", full)
    return name


def fallback_topic(q: Column) -> Column:
    """The subject that an abbreviation stands for, else the question."""
    return F.coalesce(first(q, [(_literal(k), v) for k, v in ABBREVIATIONS]), F.trim(q))


def requirement(q: Column) -> Column:
    """elective before core, else null. The words count as they are written."""
    return F.when(q.rlike("选修|elective"), "elective").when(q.rlike("核心|必修|compulsory|core"), "core").otherwise(_none())


def detail_intents(q: Column) -> Column:
    return every(F.coalesce(q, F.lit("")), [(p, k) for k, p in DETAILS])


def assessment_type(q: Column) -> Column:
    """The first type of assessment that a question names, else null."""
    return first(F.coalesce(q, F.lit("")), [(p, k) for k, p in ASSESSMENT_TYPES])


def has_assessment(kind: Column, assessments: Column) -> Column:
    """yes, no or unknown (no items): whether an item's task or category names the type; null without a type."""
    text = lambda a: F.concat(F.coalesce(a["task"], F.lit("")), F.lit(" "), F.coalesce(a["category"], F.lit("")))
    found = reduce(lambda out, x: out.when(kind == x[0], F.exists(assessments, lambda a: says(text(a), x[1]))), ASSESSMENT_TYPES, F)
    return F.when(kind.isNull(), _none()).when(F.coalesce(F.size(assessments), F.lit(0)) <= 0, "unknown").when(found, "yes").otherwise("no")


def parsed(text: Column) -> Column:
    """A JSON text as a variant, or the object between its first and last brace; null where neither can be read."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))))


def _kind(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))


def _text(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "STRING", F.trim(F.try_variant_get(v, path, "string")))


def validated(v: Column, domains: dict[str, list[str]], root: str = "$.filters") -> dict[str, Column]:
    """The slots of a draft (variant), each null where its value isn't of its kind; other keys are dropped."""
    one_of = lambda x, values: F.when(F.lower(x).isin(*values), F.lower(x))

    def flag(name: str) -> Column:
        return F.when(_kind(v, f"{root}.{name}") == "BOOLEAN", F.try_variant_get(v, f"{root}.{name}", "boolean"))

    def listed(name: str, values: list[str]) -> Column:
        found = F.transform(F.try_variant_get(v, f"{root}.{name}", "array<string>"), lambda x: F.lower(F.trim(x)))
        found = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isin(*values))))
        return F.when(_kind(v, f"{root}.{name}").startswith("ARRAY") & (F.size(found) > 0), found)

    kind, level = _kind(v, f"{root}.units"), _text(v, f"{root}.level")
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, f"{root}.units", "double"))
    number = F.coalesce(number, _text(v, f"{root}.units").try_cast("double"))
    semester = _text(v, f"{root}.semester")
    return {
        "has_exam": flag("has_exam"),
        "has_hurdle": flag("has_hurdle"),
        "midterm_status": one_of(_text(v, f"{root}.midterm_status"), STATES),
        "group_status": one_of(_text(v, f"{root}.group_status"), STATES),
        "level": F.when(F.lower(level).isin(*[x.lower() for x in domains.get("level", [])]), level),
        "units": number,
        "location": F.nullif(_text(v, f"{root}.location"), F.lit("")),
        "attendance_mode": F.nullif(_text(v, f"{root}.attendance_mode"), F.lit("")),
        "semester": F.when(semester.isin("S1", "S2"), semester),
        "course_type_exclude": listed("course_type_exclude", COURSE_TYPES),
        "course_type_only": listed("course_type_only", COURSE_TYPES),
        "code_level": listed("code_level", list("123456789")),
    }


def program_slots(q: Column) -> dict[str, Column]:
    """The slots that a question about a program gives, from its text alone."""
    group, types = group_intent(q), excluded_types(q)
    semester = F.when(~both_semesters(q), F.when(says(q, SEMESTER_2), "S2").when(says(q, SEMESTER_1), "S1"))
    null = {"course_type_exclude": "array<string>", "course_type_only": "array<string>", "code_level": "array<string>", "has_hurdle": "boolean"}
    out = {k: F.lit(None).cast(null.get(k, "string")) for k in SLOTS}
    return out | {
        "has_exam": exam_intent(q),
        "group_status": F.when(group, "has").when(~group, "none"),
        "units": F.regexp_extract(q, f"(?i){UNITS}", 1).try_cast("double"),
        "course_type_exclude": F.when(F.size(types) > 0, types),
        "semester": semester,
        "level": level_hint(q),
    }


def any_slot(slots: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a | b, [x.isNotNull() for x in slots.values()])


def plan(questions: DataFrame, question: str = "question", draft: str | None = None, domains: dict[str, list[str]] | None = None) -> DataFrame:
    """questions with plan: mode, slots, semantic_query, course_code, program_name, direction, coord_units, order, kb_query, both_semesters and
    exclude_title. A question that gives nothing to search by has the mode empty. Without a draft the mode starts as semantic."""
    domains, q = domains or {}, F.col("_q")
    empty, no = F.array().cast("array<string>"), F.lit("")
    df = questions.withColumn("_q", F.coalesce(F.col(question), no))
    df = df.withColumn("_d", parsed(F.coalesce(F.col(draft), F.lit('{"mode": "semantic"}'))) if draft else F.parse_json(F.lit('{"mode": "semantic"}')))
    text = lambda k: F.coalesce(F.trim(F.try_variant_get(F.col("_d"), f"$.{k}", "string")), no)
    code = F.upper(F.regexp_extract(q, CODE, 1))
    df = df.withColumns({
        "_code": code, "_degree": says(q, DEGREE), "_related": says(q, RELATED), "_topic": says(q, TOPIC), "_both": both_semesters(q), "_level": level_hint(q), "_digits": first_digits(q),
        "_name": F.trim(F.regexp_extract(q, f"(?i){DEGREE_NAME}", 1)), "_units": F.regexp_extract(q, f"(?i){UNITS}", 1).try_cast("double"),
        "_own": F.struct(*[v.alias(k) for k, v in program_slots(q).items()]), "_draft": F.struct(*[v.alias(k) for k, v in validated(F.col("_d"), domains).items()]),
        "_mode": F.lower(text("mode")), "_semantic": text("semantic_query"), "_kb": text("kb_query"),
    })
    c = {k: F.col(f"_{k}") for k in ("code", "degree", "related", "topic", "both", "level", "digits", "name", "units", "own", "draft", "mode", "semantic", "kb")}
    coded = c["code"] != ""
    own = {k: c["own"][k] for k in SLOTS}
    unit = text("filters.coord_unit")
    allowed = F.lower(unit).isin(*[x.lower() for x in domains.get("coordinating_unit", [])]) if domains.get("coordinating_unit") else F.lit(False)
    slots = {k: c["draft"][k] for k in SLOTS} | {
        "location": guarded(c["draft"]["location"], asked_campus(q), domains.get("location", [])),
        "attendance_mode": guarded(c["draft"]["attendance_mode"], asked_attendance(q), domains.get("attendance_mode", [])),
        "semester": F.when(~c["both"], c["draft"]["semester"]),
        "code_level": F.when(F.size(c["digits"]) > 0, c["digits"]).otherwise(c["draft"]["code_level"]),
    }
    df = df.withColumns({
        "_slots": F.struct(*[v.alias(k) for k, v in slots.items()]),
        "_coord": F.array_distinct(F.concat(faculty_units(q), F.when(allowed, F.array(unit)).otherwise(empty))), "_titles": excluded_titles(q),
        "_forced": F.when(coded & c["degree"] & says(q, PERMITTED), "permit").when(coded & c["related"], "course_to_programs").when(c["degree"] & (says(q, REQUIRED) | any_slot(own)), "program_to_courses"),
    })
    forced, some = F.col("_forced"), any_slot({k: F.col("_slots")[k] for k in SLOTS})
    easy = says(q, EASY) & ~coded & ~c["degree"] & ~c["topic"]
    guide = coded & says(q, GUIDE) & ~says(q, FACT) & ~c["degree"] & ~c["related"]
    detail = forced.isNull() & coded & ~c["degree"] & ~c["related"]
    school = forced.isNull() & (c["mode"] == "kb") & ~coded & ~c["degree"]
    program = forced.isNotNull() | (c["mode"] == "program")
    said = F.when(text("direction").isin(*DIRECTIONS), text("direction"))
    of_code = F.when(forced.isin("permit", "course_to_programs"), c["code"]).otherwise(F.coalesce(F.nullif(F.upper(text("course_code")), no), c["code"]))
    direction = F.coalesce(forced, said, F.when(of_code != "", "course_to_programs").otherwise("program_to_courses"))
    undone = program & (direction == "program_to_courses") & ~c["degree"]
    df = df.withColumns({
        "_route": F.when(easy, "easy").when(guide, "guide").when(F.col("_d").isNull() | ~c["mode"].isin(*MODES), "bad").when(detail, "detail").when(school, "kb")
        .when(program & ~undone, "program").otherwise("course"),
        "_direction": direction, "_of_code": of_code, "_undone": undone,
        "_m": F.when(undone | (c["mode"] == "course_detail"), no).when(c["mode"] == "kb", "semantic").otherwise(c["mode"]),
    })
    # The last route: slots, topics and the draft's mode against each other, a rule after another.
    levelled = {k: F.col("_slots")[k] for k in SLOTS} | {
        "level": F.coalesce(c["level"], F.col("_slots")["level"]),
        "units": F.when(F.col("_undone") & ~some, c["units"]).otherwise(F.col("_slots")["units"]),
    }
    df = df.withColumn("_slots", F.when(F.col("_route") == "course", F.struct(*[v.alias(k) for k, v in levelled.items()])).otherwise(F.col("_slots")))
    m, s, topic = F.col("_m"), F.col("_s"), c["topic"]
    df = df.withColumns({"_some": some, "_s": c["semantic"]})
    some = F.col("_some")
    plain = some & ~topic & ((F.size("_coord") > 0) | m.isin("semantic", "hybrid"))
    df = df.withColumns({"_s": F.when(plain, no).otherwise(s), "_m": F.when(plain, "filter").when(m == "", F.when(some, "filter").otherwise("semantic")).otherwise(m)})
    df = df.withColumn("_m", F.when(some & (m == "semantic"), F.when(topic, "hybrid").otherwise("filter")).otherwise(m))
    df = df.withColumn("_m", F.when(topic & (m == "filter"), F.when(some, "hybrid").otherwise("semantic")).otherwise(m))
    lacks = m.isin("semantic", "hybrid") & (s == "")
    df = df.withColumns({"_s": F.when(lacks & topic, fallback_topic(q)).otherwise(s), "_m": F.when(lacks & ~topic, F.when(m == "hybrid", "filter").otherwise("empty")).otherwise(m)})
    df = df.withColumn("_m", F.when(m.isin("filter", "hybrid") & ~some, F.when(s != "", "semantic").otherwise("empty")).otherwise(m))
    route, is_ = F.col("_route"), lambda *x: F.col("_route").isin(*x)
    light = {"has_exam": F.lit(False), "has_hurdle": F.lit(False), "course_type_exclude": F.array(*map(F.lit, ["placement", "research", "thesis"])), "level": c["level"]}
    of_program = own | {"code_level": F.when(F.size(c["digits"]) > 0, c["digits"])}

    def slot(k: str) -> Column:
        return F.when(is_("easy"), light[k]) if k in light else F

    final = {k: slot(k).when(is_("program") & (F.col("_direction") == "program_to_courses"), of_program[k]).when(is_("course"), F.col("_slots")[k]) for k in SLOTS}
    named = is_("program") & (F.col("_direction") != "course_to_programs") | is_("program") & forced.isNull()
    fields = {
        "mode": F.when(is_("easy"), "filter").when(is_("detail"), "course_detail").when(is_("bad"), "empty").when(is_("course"), m).otherwise(route),
        "slots": F.struct(*[v.alias(k) for k, v in final.items()]),
        "semantic_query": F.when(is_("course"), s).otherwise(no),
        "course_code": F.when(is_("guide", "detail"), c["code"]).when(is_("program"), F.col("_of_code")).otherwise(no),
        "program_name": F.when(named, expanded(F.coalesce(F.nullif(text("program_name"), no), F.when(forced.isNotNull() | (F.col("_direction") == "permit"), c["name"]), no))).otherwise(no),
        "direction": F.when(is_("program"), F.col("_direction")).otherwise(no),
        "coord_units": F.when(is_("easy", "guide", "bad"), empty).otherwise(F.col("_coord")),
        "order": F.when(is_("easy"), "assessments_asc").otherwise(no),
        "kb_query": F.when(is_("kb"), c["kb"]).otherwise(no),
        "both_semesters": c["both"] & ~is_("easy", "guide", "bad"),
        "exclude_title": F.when(is_("easy", "guide", "bad"), empty).otherwise(F.col("_titles")),
    }
    return df.withColumn("plan", F.struct(*[v.alias(k) for k, v in fields.items()])).select(*questions.columns, "plan")
