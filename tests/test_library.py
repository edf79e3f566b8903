"""What no SQL says: parsers, schedules, sources, streams, edge cases of text functions."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import derive, text
from lodestone.functions.stem import stem
from lodestone.operators import answers, filters, ingest, planner, retrieval, rules
from lodestone.plans.streams import _STORE, settings
from lodestone.queries import QUERIES
from lodestone.sources import files
from lodestone.streaming import increments, limiter


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_prerequisites():
    tree = rules.parse_prerequisite("(OBOE2200 or LUTE2300) and HARP3100")
    assert rules.satisfied(tree, {"LUTE2300", "HARP3100"}) == (True, None)
    assert rules.satisfied(tree, {"LUTE2300"}) == (False, "HARP3100")
    assert rules.parse_prerequisite("FLUT4010 or 4020") == {"op": "or", "of": [{"op": "is", "of": "FLUT4010"}, {"op": "is", "of": "FLUT4020"}]}
    assert rules.parse_prerequisite("A or") == {"op": "raw", "of": "A or"} and rules.parse_prerequisite(" ") is None
    assert rules.parse_prerequisite("HARP3000, HARP3100 + VIOL1200 & OBOE2200")["op"] == "and"
    assert rules.satisfied({"op": "raw", "of": "Ask us"}, set()) == (True, "check: Ask us")
    assert rules.parse_formula("Part K AND ( Part L OR Part M )")["op"] == "and"
    assert rules.parse_formula("AND Part K") is None and rules.parse_formula("(Part K") is None and rules.parse_formula("Part K and 9 points") is None


def test_schedule():
    trees = {"BBBB1000": rules.parse_prerequisite("AAAA1000"), "CCCC1000": rules.parse_prerequisite("DDDD1000"), "DDDD1000": rules.parse_prerequisite("CCCC1000")}
    got = rules.schedule(["BBBB1000", "AAAA1000", "CCCC1000", "DDDD1000", "AAAA1000", "YYYY1000"], trees, {"BBBB1000": {"S1"}}, {"YYYY1000": 4.0}, 4.0, 4, year_long=frozenset({"YYYY1000"}))
    assert got["place"] == {"YYYY1000": 1, "AAAA1000": 0, "BBBB1000": 2}
    assert got["problems"] == ["cycle: CCCC1000", "cycle: DDDD1000"]
    assert rules.schedule(["AAAA1000"], {}, {}, {"AAAA1000": 9.0}, 8.0, 2)["problems"] == ["no slot: AAAA1000"]


def test_assignment_moves_what_another_bin_can_spare():
    bins = [{"codes": ["A", "B"], "need": 2, "cap": 2}, {"codes": ["A"], "need": 2, "cap": 2}, {"codes": ["C"], "need": 0, "cap": 1}]
    assert rules.assign(bins, {"A": 2.0, "B": 2.0, "C": 2.0}) == {"A": 1, "B": 0, "C": 2}


def test_status(spark):
    assigned = spark.createDataFrame([(1, 0, 10.0), (1, 1, 1.0)], "plan_id long, bin int, units double")
    limits = spark.createDataFrame([(1, 0, 4.0, 8.0), (1, 1, 2.0, 4.0), (1, 2, 0.0, 4.0)], "plan_id long, bin int, need double, cap double")
    status = rules.rule_status(assigned, limits)
    assert [tuple(r)[2:] for r in status.orderBy("bin").collect()] == [(10.0, 8.0, True, True), (1.0, 1.0, False, False), (0.0, 0.0, False, True)]
    assert rules.overall(status).first()["counted"] == 9.0


def test_text(spark):
    assert column(spark, ["| x | y |\n|---|---|\n| 1 | -- |"], text.linear_tables) == ["x, y\n1"]
    assert column(spark, ["see abcd1234.", "xabcd1234", "abcd12345"], text.course_code) == ["ABCD1234", "", ""]
    assert column(spark, ["你好", "hi", None], text.detect_lang) == ["zh", "en", "en"]
    assert column(spark, ["a" * 50, "", "  "], lambda c: F.size(text.hard_split(c, 5, 1))) == [4, 0, 0]
    assert column(spark, ["- •  ok", None, "a long enough answer"], lambda c: text.is_empty_answer(c, "no information")) == [True, True, False]
    assert column(spark, ["see [X1]\nsee [Y2]\nnone"], lambda c: text.guard_citations(c, F.array(F.lit("X1")), r"\[(\w+)\]")) == ["see [X1]\nnone"]
    assert column(spark, ["in 1999", "2024 and 2031", "none", "code 120199 x, 2031a"], lambda c: text.out_of_range_year(c, 2020, 2028)) == [1999, 2031, None, None]


def test_derived(spark):
    assert column(spark, ["Semester 1, 2025 (24/02/2025 - 21/06/2025)", "(24/02/2025 - 22/11/2025)", "(31/02/2025 - 22/11/2025)", None], derive.year_long) == [False, True, None, None]
    assert column(spark, ["Summer Semester, 2024", "Semester 2, 2025"], lambda c: derive.semester_and_year(c)[0]) == ["Summer", "S2"]
    assert column(spark, ["2024-01-01", "bad", None], lambda c: derive.stale(c, F.lit("2025-01-01").cast("date"))) == [True, False, False]
    schema = "title string, a array<struct<task: string, category: string>>"
    rows = [
        ("Intro", [("essay", "Thesis, thesis")]), ("Thesis research", []), ("Ways of research", None), ("Internship thesis", []), (None, [("Quiz", "quiz"), ("Final exam", "exam")]),
        ("Capstone research", [("In-class test", None)]), ("Researching honours", [("Exam halfway", "exam"), ("End-of-semester paper", "Exam")]), ("Studio", [("Final test", "x"), (None, None)]),
    ]
    df = spark.createDataFrame(rows, schema)
    assert [r[0] for r in df.select(derive.course_type(F.col("title"), F.col("a"))).collect()] == ["thesis", "thesis", "coursework", "placement", "coursework", "research", "coursework", "coursework"]
    assert [r[0] for r in df.select(derive.midterm_status(F.col("a"))).collect()] == ["none", "none", "none", "none", "unknown", "has", "unknown", "none"]


def test_schedules_take_as_many_slots_as_plans_need(spark):
    code = lambda i: f"CODE{i:04d}"
    chain = [(1, code(i), 2.0, code(i - 1) if i else "", ["S1", "S2"]) for i in range(17)] + [(2, code(i), 2.0, code(i - 1) if i else "", ["S2"]) for i in range(20)]
    df = spark.createDataFrame(chain, "plan_id long, code string, units double, prerequisite string, offered array<string>")
    found = {(r.plan_id, r.code): r.slot for r in rules.schedules(df, n_slots=None).collect()}
    assert found == {(1, code(i)): i for i in range(17)} | {(2, code(i)): 2 * i + 1 for i in range(20)}
    assert {r.problem for r in rules.schedules(df, n_slots=16).filter("plan_id = 1 AND code IS NULL").collect()} == {f"no slot: {code(16)}"}
    got = rules.schedule([code(0), code(1)], {}, {}, {code(0): 16.0, code(1): 16.0}, 8.0, None, "S2", frozenset({code(0), code(1)}))
    assert got["place"] == {code(0): 2, code(1): 4} and not got["problems"]


def test_timetable_problems_by_brute_force(spark):
    """Plans whose courses are needed in many other plans: pairs are made within plans only."""
    import random

    rng = random.Random(6)
    placed = [(p, f"C{rng.randrange(12)}", rng.choice([0, 1, 2, 3, None]), rng.choice([2.0, 5.0, None]), rng.choice([["S1"], ["S1", "S2"], None])) for p in [*range(30), None] for _ in range(rng.randrange(7))]
    needs = sorted({(f"C{rng.randrange(12)}", f"C{rng.randrange(12)}") for _ in range(40)}) + [("C1", "C2"), ("C1", "C2"), ("C3", "C3"), ("C4", None)]
    wanted = []
    for p, c, slot, _, offered in placed:
        wanted += [(p, "not offered", c)] * (offered is not None and ("S1" if slot in (0, 2) else "S2") not in offered)
        wanted += [(p, "prerequisite later", c) for a, b in needs if a == c and p is not None for q, d, s, *_ in placed if (p, b) == (q, d) and None not in (s, slot) and s >= slot]
    for p, slot in {(x[0], x[2]) for x in placed}:
        wanted += [(p, "over cap", None if slot is None else str(slot))] * (sum(x[3] or 0 for x in placed if (x[0], x[2]) == (p, slot)) > 4)
    df = spark.createDataFrame(placed, "plan_id long, code string, slot int, units double, offered array<string>")
    found = rules.timetable_problems(df, spark.createDataFrame(needs, "code string, needs string"), 4.0)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str) and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_filters_raise_on_nothing(spark):
    with pytest.raises(ValueError):
        filters.where(spark.range(1), {"level": None, "nonsense": 3})
    assert filters.describe({"has_exam": False, "level": "x", "units": 2, "course_type_exclude": ["a"]}) == "has_exam = false AND level = 'x' AND units = 2 AND course_type NOT IN ('a')"
    df = spark.createDataFrame([(False, 0), (True, 2), (None, 0)], "has_exam boolean, units int")
    assert filters.where(df, {"has_exam": False, "units": 0}).count() == 1


def test_retrieval_limits(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, embedding array<double>")
    with pytest.raises(ValueError):
        retrieval.keyword_search(df, "the", 3)
    assert retrieval.knn_join(df.limit(0), df, 2).count() == 0


def test_index_search_by_brute_force(spark, monkeypatch):
    """Each vector stands once in the index, and a search finds the nearest of those that share a bucket, in whatever blocks they lie."""
    import numpy as np

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 50)
    x = np.random.default_rng(3).normal(size=(200, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, embedding array<double>")
    index = retrieval.hyperplane_index(df, tables=3, planes=4)
    cells = {r.id: r.cells for r in index.collect()}
    normals = np.random.default_rng(7).normal(size=(12, 5)).round(6)
    assert cells == {i: [sum(int(v @ normals[4 * t + p] >= 0) << p for p in range(4)) for t in range(3)] for i, v in enumerate(x)} and index.count() == 200
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted = []
    for q in range(0, 200, 10):
        meet = [i for i in range(200) if i != q and any(a == b for a, b in zip(cells[i], cells[q], strict=True))]
        wanted += [(q, i) for i in sorted(meet, key=lambda i: -(unit[i] @ unit[q]))[:4]]
    found = retrieval.index_search(index, df.filter("id % 10 = 0"), 4)
    assert sorted((r.query_id, r.id) for r in found.collect()) == sorted(wanted)


def test_ingest(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, keep string")
    new = spark.createDataFrame([("b", 5, 1), ("b", None, 2), ("c", 7, 1)], "k string, v int, o int")
    assert sorted(map(tuple, ingest.upsert(base, new, "k", "o").collect())) == [("a", 1, "x"), ("b", None, "y"), ("c", 7, None)]


def test_sources(spark, tmp_path):
    (tmp_path / "w.txt").write_text("a b\n\n b c ")
    assert sorted(r[0] for r in files.word_set(spark, str(tmp_path / "w.txt")).collect()) == ["a", "b", "c"]
    assert files.word_set(spark, str(tmp_path / "none.txt")).count() == 0
    (tmp_path / "v.tsv").write_text("")
    with pytest.raises(ValueError):
        files.vocabulary(spark, str(tmp_path / "v.tsv"))
    (tmp_path / "o.jsonl").write_text('{"id": "a", "x": 1}\n{"id": "a", "x": 2}\n')
    assert [tuple(r) for r in files.overrides(spark, str(tmp_path / "o.jsonl"), "id", "x int").collect()] == [("a", 2)]
    g = tmp_path / "g"
    g.mkdir()
    (g / "ABCD1234_2025.md").write_text("---\ncode: ABCD1234\nnote: a: b\n---\nbody")
    (g / "README.md").write_text("no guide")
    row = files.guides(spark, str(g)).first()
    assert row["front"] == {"code": "ABCD1234", "note": "a: b"} and row["body"] == "body"
    html = "<html><title>T</title><nav>x</nav><h1>A</h1><p>one &amp; two</p><h2>B</h2><p>three</p><script>window.D = {\"a\": {\"b\": 1}};</script></html>"
    df = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    assert [r["_text"] for r in files.page_texts(df).orderBy("id").collect()] == ["# A\none & two\n## B\nthree", ""]
    assert [r[0] for r in df.orderBy("id").select(files.embedded_object(F.col("html"), "D")).collect()] == ['{"a": {"b": 1}}', None]
    assert [r["heading"] for r in files.chunks(files.page_texts(df), "id", most=2, least=1, overlap=0).collect()] == ["T > A", "T > B"]
    assert list(files.packed(files.sections("# A\n## B\n### C\nx\n# D\ny\n####  no\n"), 9)) == [("B", "C", "x\n\ny\n####  no")]


def test_plan_without_a_draft(spark):
    asked = ["tell me about OBOE2200", "which programs is oboe2200 elective in", "can I take LUTE2300 in the Master of Music", "", "courses about machine learning", "easy stuff", None, "business and both s1 and s2"]
    df = planner.plan(spark.createDataFrame(list(enumerate(asked)), "i int, question string"))
    plans = [r["plan"] for r in df.orderBy("i").collect()]
    assert [p["mode"] for p in plans] == ["course_detail", "program", "program", "empty", "semantic", "empty", "empty", "semantic"]
    assert plans[1]["direction"] == "course_to_programs" and plans[2]["direction"] == "permit" and plans[2]["program_name"] == "Master of Music"
    assert plans[7]["both_semesters"] and plans[7]["coord_units"] == ["Business School", "Economics School"] and plans[7]["slots"]["semester"] is None


def test_stems_and_queries():
    words = {"relational": "relat", "hopping": "hop", "hoping": "hope", "skies": "sky", "dying": "die", "happily": "happili", "generously": "generous", "cries": "cri", "ties": "tie", "controlling": "control", "inning": "inning"}
    assert {w: stem(w) for w in words} == words
    assert retrieval.websearch("the running OR jumped dogs -cats") == ([{"run", "jump"}, {"dog"}], {"cat"})
    with pytest.raises(ValueError):
        retrieval.websearch("the of and")


def test_gate(spark):
    questions = spark.createDataFrame([(1, "what is a gizmo in 2024"), (2, "a gizmo from 2031"), (3, "the widget"), (4, "when"), (5, "gadget 120199")], "id long, question string")
    found = spark.createDataFrame([(3, "A Widget is here"), (5, None)], "id long, text string")
    vocabulary = spark.createDataFrame([("gizmo",)], "word string")
    assert [tuple(r) for r in answers.gate(questions, found, vocabulary).orderBy("id").collect()] == [(1, True, "ok", ""), (2, False, "year", "2031"), (3, True, "ok", ""), (4, True, "ok", ""), (5, False, "entity", "gadget")]


def test_lists_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("https://x.example/a,b", "t")], "url string, title string")
    files.write_url_list(df, str(tmp_path / "list"))
    assert files.url_list(spark, str(tmp_path / "list")).collect() == df.collect()
    with pytest.raises(ValueError):
        files.url_list(spark, str(tmp_path / "list"), ).drop("url").write.option("header", True).csv(str(tmp_path / "bad"))
        files.url_list(spark, str(tmp_path / "bad"))
    files.write_json_lines(df, str(tmp_path / "lines"))
    assert files.json_lines(spark, str(tmp_path / "lines"), df.schema).collect() == df.collect()
    words = spark.createDataFrame([("a", 3), ("b", 1)], "word string, freq long")
    files.write_table(words, str(tmp_path / "vocabulary"))
    assert sorted(files.vocabulary(spark, str(tmp_path / "vocabulary")).collect()) == sorted(words.collect())


def test_knn_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 5)
    df = spark.createDataFrame([(i, [float(i % 4 + 1), 1.0, float(i // 7)]) for i in range(23)] + [(99, None)], "id long, embedding array<double>")
    rows = {r["id"]: r["embedding"] for r in df.collect() if r["embedding"]}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    found = retrieval.knn_join(df, df, 4).collect()
    for q, v in rows.items():
        wanted = sorted((-round(cos(v, w), 9), i) for i, w in rows.items() if i != q)[:4]
        assert sorted((-round(r["sim"], 9), r["id"]) for r in found if r["query_id"] == q) == wanted


def test_stream_equals_table(spark, tmp_path):
    rows = [(i, i % 3, f"2024-01-01 00:{i % 7:02d}:{i % 60:02d}") for i in range(90)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    with settings(spark, _STORE):  # state with a time to live asks for batches without end, if it may
        stream = limiter.stream_allowed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user_id", 60, 3)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(60)
    wanted = limiter.window_allowed(df, "user_id", 60, 3).select("event_id", "allowed")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, wanted.collect()))


def test_incremental_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = spark.createDataFrame([], "id long, x string").schema
    for batch in ([1, 2, 2], [2, 3]):
        (tmp_path / "in" / f"{batch[-1]}.json").write_text("\n".join(json.dumps({"id": i, "x": "v"}) for i in batch))
        increments.ingest_new(spark, str(tmp_path / "in"), schema, str(tmp_path / "t"), str(tmp_path / "ck"), "id").awaitTermination(60)
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "t")).select("id").collect()) == [1, 2, 3]


def test_a_scorer_may_fail(spark):
    rows = [(1, 1, "aa"), (2, 1, "b"), (3, 1, "cccc"), (4, 2, "dd"), (5, 2, "boom boom"), (6, 3, "alone")]
    df = spark.createDataFrame(rows, "id int, question int, text string").repartition(3)

    def score(texts):
        if texts.str.contains("boom").any():
            raise RuntimeError("no model")
        return texts.str.len().astype(float)

    kept = retrieval.rerank(df.filter("question <> 2"), score, [F.asc("id")], group="question")
    assert [r.id for r in kept.collect()] == [3, 1, 2, 6]
    assert [r.id for r in retrieval.rerank(df.filter("question = 2"), score, [F.asc("id")], group="question").collect()] == [4, 5]
    assert [r.id for r in retrieval.rerank(df.filter("id < 4"), lambda x: x.iloc[:0], [F.asc("id")]).collect()] == [1, 2, 3]
    assert [r.id for r in retrieval.rerank(df, None, [F.desc("id")]).collect()] == [6, 5, 4, 3, 2, 1]
    assert [r.id for r in retrieval.rerank(df, F.length("text"), [F.asc("id")]).collect()] == [5, 6, 3, 1, 4, 2]


def test_described_like_describe(spark):
    slots = [{"has_exam": False, "level": "x", "units": 2, "course_type_exclude": ["a", "b"]}, {"has_exam": None, "level": "y", "units": 7, "course_type_exclude": []}, {"has_exam": True, "level": None, "units": None, "course_type_exclude": None}]
    df = spark.createDataFrame(slots, "has_exam boolean, level string, units int, course_type_exclude array<string>")
    assert [r[0] for r in df.select(filters.described({c: F.col(c) for c in df.columns})).collect()] == [filters.describe(x) for x in slots]


def test_named_files_and_walks(spark, tmp_path):
    df = spark.createDataFrame([("A", "one\ntwo"), ("B", "")], "name string, text string")
    files.write_named(df, f"file://{tmp_path}/n", "md")
    assert {x.name: x.read_text().rstrip("\n") for x in (tmp_path / "n").iterdir() if not x.name.startswith(".")} == {"A.md": "one\ntwo", "B.md": ""}
    twice = spark.createDataFrame([("1/A", "one"), ("2/A", "two"), ("B", "three")], "name string, text string")
    files.write_named(twice, f"file://{tmp_path}/m", "md")
    assert {str(x.relative_to(tmp_path / "m")): x.read_text() for x in (tmp_path / "m").rglob("[AB].md")} == {"1/A.md": "one\n", "2/A.md": "two\n", "B.md": "three\n"}
    with pytest.raises(Exception, match="more than one file of a name: A"):
        files.write_named(df.unionByName(df.limit(1)), f"file://{tmp_path}/o", "md")
    from lodestone.operators import trees

    walked = trees.walk(spark.createDataFrame([(1, '{"children": [{"x": 1}, {"children": [{"x": 2}]}]}')], "i int, tree string"), "i", "tree")
    assert sorted((r.path, r.depth) for r in walked.collect()) == [("", 0), ("/0", 1), ("/1", 1), ("/1/0", 2)]
    assert not [t for t in spark.catalog.listTables() if t.isTemporary and t.name.startswith("trees_")]


def test_guides_whose_names_come_again(spark, tmp_path):
    """Parts ten thousand apart have files of one name, and each is a guide."""
    spark.createDataFrame([(k, f"part {k}") for k in (100, 150, 10100, 20100)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found = sorted((r.name, r.title, r.part, r.body) for r in QUERIES["src06_guide_files"](spark, str(tmp_path)).collect())
    assert found == [("ABCD0100_2025.md", f"part {k}", str(k), f"about part {k}") for k in (100, 10100)]


def test_rule_codes_read_each_page_once(spark):
    """Pages are walked once, only rules leave the walk, and what stands inside a rule is told by whole steps of its path."""
    from lodestone.operators import programs

    course = lambda *xs: [{"rowType": "CurriculumReference", "curriculumReference": {"code": x}} for x in xs]
    rule = lambda ref, body: {"header": {"partReference": ref}, "body": body}
    page = {"r": rule("A", [*course("AAAA1000", "PLANX"), rule("B", [*course("BBBB1000"), rule("C", course("CCCC1000", "AAAA1000"))])]), "r2": rule("D", course("DDDD1000")), "x": {"header": {}}}
    df = spark.createDataFrame([(1, json.dumps(page)), (2, json.dumps(page["r2"])), (3, "{"), (4, None)], "id long, page string")
    nodes = programs.objects(df, "id", "page", ("header", "body"))
    assert [(r.id, r.path) for r in nodes.orderBy("id", "at").collect()] == [("1", "/r"), ("1", "/r/body/0002"), ("1", "/r/body/0002/body/0001"), ("1", "/r2"), ("2", "")]
    assert {tuple(r) for r in nodes.select("id", "at", "path").collect()} < {tuple(r) for r in programs.objects(df, "id", "page").select("id", "at", "path").collect()}
    found = programs.rule_codes(programs.rules(nodes))
    assert {(r.id, r.ref): (r.enumerated, r.plans, r.below) for r in found.collect()} == {
        ("1", "A"): (["AAAA1000"], ["PLANX"], ["AAAA1000", "BBBB1000", "CCCC1000"]), ("1", "B"): (["BBBB1000"], [], ["AAAA1000", "BBBB1000", "CCCC1000"]),
        ("1", "C"): (["AAAA1000", "CCCC1000"], [], ["AAAA1000", "CCCC1000"]), ("1", "D"): (["DDDD1000"], [], ["DDDD1000"]), ("2", "D"): (["DDDD1000"], [], ["DDDD1000"]),
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Join" not in plan


def test_chunks_of_pages_by_brute_force(spark):
    """Chunks of the pages, in order, are their texts' sections, packed again by a reading of its own."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r.page_id: (r._title, r._text) for r in files.page_texts(pages).collect()}
    found = {}
    for r in files.chunks(files.page_texts(pages), "page_id").orderBy("id", "chunk_id").collect():
        found.setdefault(int(r.id), []).append(r)
    for page, rows in found.items():
        title, body = texts[page]
        said = re.sub(r"(?m)^#{1,3} .*$", "", body)
        for r in rows:
            assert r.tokens == max(1, len(r.text) // 4) and r.short == (r.tokens < 30)
            assert not title or r.heading.split(" > ")[0] == title or title in r.heading
            for line in filter(None, map(str.strip, r.text.split("\n"))):
                assert line in said or any(line[:40] in x for x in said.split("\n")), (page, line)
    assert set(found) <= set(texts) and len(found) > 0.5 * len([1 for _, b in texts.values() if len(b) > 400])
