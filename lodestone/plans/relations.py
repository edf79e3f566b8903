"""Queries of relations, aggregates, sets and loads; suppliers stand for programs, parts for courses, lineitem for what links them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import ingest, relations
from lodestone.registry import query, table


def links(spark: SparkSession, d: str) -> DataFrame:
    """program, course, requirement, one_of, plan and a line number that orders them."""
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("program"), F.col("l_partkey").alias("course"), F.when(F.col("l_returnflag") == "A", "core").otherwise("elective").alias("requirement"),
        (F.col("l_linestatus") == "O").alias("one_of"), F.col("l_linenumber").alias("plan"), F.col("l_orderkey").alias("ord"), "l_returnflag", "l_linestatus", "l_quantity",
    )


LINKS = "(SELECT l_suppkey AS program, l_partkey AS course, CASE WHEN l_returnflag = 'A' THEN 'core' ELSE 'elective' END AS requirement, l_linestatus = 'O' AS one_of, l_linenumber AS plan, l_orderkey AS ord, l_returnflag, l_linestatus, l_quantity FROM lineitem)"


@query("joi01_owner_left", f"SELECT program, s_name, course, requirement, plan, ord FROM {LINKS} LEFT JOIN supplier ON program = s_suppkey AND s_acctbal > 0 WHERE course = 5")
def joi01(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("program"), "s_name")
    return relations.with_name(links(spark, d).filter("course = 5"), names, "program", "s_name").select("program", "s_name", "course", "requirement", "plan", "ord")


@query("joi02_fanout_free", f"SELECT DISTINCT course, requirement, plan, p_name FROM {LINKS} LEFT JOIN (SELECT p_partkey, min(p_name) AS p_name FROM part GROUP BY 1) ON course = p_partkey WHERE program = 1")
def joi02(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.col("p_partkey").alias("course"), "p_name")
    return relations.with_name(links(spark, d).filter("program = 1").select("course", "requirement", "plan").distinct(), names, "course", "p_name")


@query("joi03_exclusions", "SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 1 WHERE s_acctbal < 1000")
def joi03(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").filter("n_regionkey = 1")
    df = table(spark, d, "supplier").filter("s_acctbal < 1000")
    return df.join(nations, df.s_nationkey == nations.n_nationkey, "left").select("s_suppkey", "s_name", "n_name")


@query("joi04_exists", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS big FROM customer")
def joi04(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("big", F.lit(True))
    return table(spark, d, "customer").join(big, "c_custkey", "left").select("c_custkey", F.coalesce("big", F.lit(False)).alias("big"))


@query("joi05_hydrate", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def joi05(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(wanted, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("joi06_self_semi", f"SELECT DISTINCT course FROM {LINKS} WHERE one_of AND course IN (SELECT course FROM {LINKS} WHERE requirement = 'core')")
def joi06(spark: SparkSession, d: str) -> DataFrame:
    rows = links(spark, d)
    return rows.filter("one_of").select("course").join(rows.filter("requirement = 'core'").select("course"), "course", "left_semi").distinct()


@query("joi07_matched_and_skipped", "SELECT count(vec_id) AS matched, count(*) - count(vec_id) AS skipped FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def joi07(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    yes, no = ingest.matched(table(spark, d, "documents").select("doc_id"), vectors, "doc_id")
    both = yes.select(F.lit(1).alias("m")).unionByName(no.select(F.lit(0).alias("m")))
    return both.agg(F.sum("m").alias("matched"), F.count_if(F.col("m") == 0).alias("skipped"))


@query("joi08_override", "SELECT d.doc_id, coalesce(CASE quality WHEN 1 THEN 'has' WHEN 0 THEN 'none' END, 'unknown') AS status, quality IS NOT NULL AS changed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def joi08(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("doc_id", F.lit("unknown").alias("status"))
    over = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "has").when(F.col("quality") == 0, "none").alias("new"))
    return own.join(over, "doc_id", "left").select("doc_id", F.coalesce("new", "status").alias("status"), F.col("new").isNotNull().alias("changed"))


@query("joi10_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def joi10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("agg01_collapse_lists", f"SELECT program, requirement, array_to_string(list_sort(list(DISTINCT l_linestatus)), '|') AS lists, array_to_string(list_sort(list(DISTINCT plan::VARCHAR)), '|') AS plans, count(*) AS n FROM {LINKS} GROUP BY 1, 2")
def agg01(spark: SparkSession, d: str) -> DataFrame:
    return relations.collapsed(links(spark, d), ["program", "requirement"], {"l_linestatus": "lists", "plan": "plans"})


@query("agg02_strongest_signal", f"SELECT course, CASE WHEN bool_or(l_quantity > 48) THEN 'tree' WHEN bool_or(l_quantity > 40) THEN 'raw' WHEN bool_or(l_quantity > 30) THEN 'null' ELSE 'no_data' END AS signal FROM {LINKS} GROUP BY 1")
def agg02(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return links(spark, d).groupBy("course").agg(relations.strongest([(q > 48, "tree"), (q > 40, "raw"), (q > 30, "null")], "no_data").alias("signal"))


@query("agg03_distinct_under_predicates", f"SELECT count(DISTINCT course) AS n_all, count(DISTINCT course) FILTER (WHERE one_of) AS n_one_of FROM {LINKS}")
def agg03(spark: SparkSession, d: str) -> DataFrame:
    per = links(spark, d).groupBy("course").agg(F.bool_or("one_of").alias("o"))
    return per.agg(F.count("*").alias("n_all"), F.count_if("o").alias("n_one_of"))


@query("agg04_max_per_key", "SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1")
def agg04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))


@query("agg05_distinct_on", "SELECT source, arg_min(lang, doc_id) AS lang, min(doc_id) AS doc_id FROM documents GROUP BY source")
def agg05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.min_by("lang", "doc_id").alias("lang"), F.min("doc_id").alias("doc_id"))


@query("agg06_sorted_sets", "SELECT source, array_to_string(list_sort(list(DISTINCT lang)), '|') AS langs FROM documents GROUP BY source")
def agg06(spark: SparkSession, d: str) -> DataFrame:
    return relations.collapsed(table(spark, d, "documents").select("source", "lang"), ["source"], {"lang": "langs"}).drop("n")


@query("agg07_offerings", f"SELECT course, array_to_string(list_sort(list_distinct(list(CASE l_returnflag WHEN 'A' THEN 'S1' WHEN 'R' THEN 'S2' ELSE 'S3' END) || CASE WHEN course % 7 = 0 THEN ['S2'] ELSE [] END)), '|') AS semesters FROM {LINKS} GROUP BY course")
def agg07(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("l_returnflag") == "A", "S1").when(F.col("l_returnflag") == "R", "S2").otherwise("S3")
    own = F.array_union(F.collect_set(s), F.when(F.col("course") % 7 == 0, F.array(F.lit("S2"))).otherwise(F.array().cast("array<string>")))
    return links(spark, d).groupBy("course").agg(F.array_join(F.array_sort(own), "|").alias("semesters"))


RANK = "CASE WHEN requirement = 'core' AND NOT one_of THEN 0 WHEN requirement = 'core' THEN 1 ELSE 2 END"


@query("agg08_best_rank", f"SELECT program, ord, plan, {RANK} AS rank FROM {LINKS} QUALIFY row_number() OVER (PARTITION BY program ORDER BY {RANK}, ord, plan) = 1")
def agg08(spark: SparkSession, d: str) -> DataFrame:
    rows = links(spark, d)
    return relations.best_of(rows, "program", relations.requirement_rank(F.col("requirement"), F.col("one_of")), ["ord", "plan"]).select("program", "ord", "plan", F.col("_rank").alias("rank"))


@query("agg09_three_state_tally", f"SELECT rank, count(*) AS n_programs FROM (SELECT program, min({RANK}) AS rank FROM {LINKS} GROUP BY 1) GROUP BY 1")
def agg09(spark: SparkSession, d: str) -> DataFrame:
    rank = relations.requirement_rank(F.col("requirement"), F.col("one_of"))
    return links(spark, d).groupBy("program").agg(F.min(rank).alias("rank")).groupBy("rank").agg(F.count("*").alias("n_programs"))


@query("agg10_slot_collapse", "SELECT l_orderkey, min(l_linenumber) AS first, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey), '|') AS members FROM lineitem GROUP BY l_orderkey, CASE WHEN l_linestatus = 'O' THEN 'O' ELSE '#' || l_linenumber END")
def agg10(spark: SparkSession, d: str) -> DataFrame:
    df = relations.slots(table(spark, d, "lineitem"), ["l_orderkey"], F.when(F.col("l_linestatus") == "O", "O"), "l_partkey", "l_linenumber")
    return df.select("l_orderkey", "first", F.array_join("members", "|").alias("members"))


SATISFIABLE = "(SELECT l_orderkey, sum(u) AS satisfiable FROM (SELECT l_orderkey, max(l_quantity) AS u FROM lineitem GROUP BY l_orderkey, CASE WHEN l_linestatus = 'O' THEN 'O' ELSE '#' || l_linenumber END) GROUP BY 1)"


def _satisfiable(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").withColumns({"item": F.col("l_linenumber").cast("string"), "eq": F.when(F.col("l_linestatus") == "O", "O")})
    return relations.satisfiable_units(items, "l_orderkey", "l_quantity", "eq")


@query("agg11_satisfiable_units", f"SELECT * FROM {SATISFIABLE}")
def agg11(spark: SparkSession, d: str) -> DataFrame:
    return _satisfiable(spark, d)


@query("agg12_mandatory_select", f"SELECT l_orderkey, total > 0 AND abs(total - satisfiable) < 1e-6 AS mandatory FROM {SATISFIABLE} JOIN (SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1) USING (l_orderkey)")
def agg12(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"))
    return _satisfiable(spark, d).join(total, "l_orderkey").select("l_orderkey", relations.mandatory(F.lit(True), F.col("total"), F.col("satisfiable"), F.lit(True)).alias("mandatory"))


@query("agg13_word_frequency", "SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]+')) AS word FROM documents) GROUP BY word")
def agg13(spark: SparkSession, d: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z][a-z0-9]+)"), 1)).alias("word")
    return table(spark, d, "documents").select(words).groupBy("word").agg(F.count("*").alias("freq"))


@query("agg14_ordered_distinct", "SELECT l_orderkey, array_to_string(list(l_suppkey ORDER BY first, l_suppkey), '|') AS suppliers FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def agg14(spark: SparkSession, d: str) -> DataFrame:
    return relations.ordered_distinct(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber").select("l_orderkey", F.array_join("l_suppkey", "|").alias("suppliers"))


@query("agg15_stats", "SELECT round(avg(t), 6) AS mean, median(t) AS median, min(t) AS low, max(t) AS high, round(count(*) FILTER (WHERE t BETWEEN 50 AND 300) / count(*), 6) AS band FROM (SELECT greatest(1, length(text) // 4) AS t FROM documents)")
def agg15(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("t"))
    return t.agg(F.round(F.avg("t"), 6).alias("mean"), F.percentile("t", 0.5).alias("median"), F.min("t").alias("low"), F.max("t").alias("high"), F.round(F.count_if(F.col("t").between(50, 300)) / F.count("*"), 6).alias("band"))


@query("agg16_confusion", "SELECT quality, n_chars > 500 AS predicted, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def agg16(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return df.groupBy("quality", (F.col("n_chars") > 500).alias("predicted")).agg(F.count("*").alias("n"))


@query("agg17_pivot", "SELECT turn, avg(length(text)) FILTER (WHERE role = 'user') AS user_len, avg(length(text)) FILTER (WHERE role = 'assistant') AS assistant_len FROM conversations GROUP BY turn")
def agg17(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "conversations").select("turn", "role", F.length("text").alias("n")).groupBy("turn").pivot("role", ["user", "assistant"]).avg("n")
    return df.withColumnsRenamed({"user": "user_len", "assistant": "assistant_len"})


@query("agg18_load_counters", "SELECT count(*) AS n, count(*) FILTER (WHERE quality IS NULL) AS unlabelled, count(*) FILTER (WHERE toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def agg18(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("agg19_units_by_level", "SELECT l_suppkey, regexp_extract(p_brand, '[0-9]') AS level, round(sum(l_quantity), 6) AS units FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def agg19(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", "[0-9]", 0).alias("level"))
    return table(spark, d, "lineitem").join(part, "l_partkey").groupBy("l_suppkey", "level").agg(F.round(F.sum("l_quantity"), 6).alias("units"))


@query("set01_union_of_lists", "SELECT source, len(list_distinct(list(DISTINCT lang) || ['en', 'xx'])) AS n FROM documents GROUP BY source")
def set01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.size(F.array_union(F.collect_set("lang"), F.array(F.lit("en"), F.lit("xx")))).cast("long").alias("n"))


SETS = "(SELECT program, list(DISTINCT course) FILTER (WHERE requirement = 'core') AS a, list(DISTINCT course) FILTER (WHERE one_of) AS b FROM {links} GROUP BY program)"


@query("set02_set_tests", f"SELECT program, len(list_intersect(coalesce(a, []), coalesce(b, []))) AS n_both, len(coalesce(a, [])) - len(list_intersect(coalesce(a, []), coalesce(b, []))) AS n_only FROM {SETS.format(links=LINKS)}")
def set02(spark: SparkSession, d: str) -> DataFrame:
    rows = links(spark, d).groupBy("program", "course").agg(F.bool_or(F.col("requirement") == "core").alias("a"), F.bool_or("one_of").alias("b"))
    return rows.groupBy("program").agg(F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if(F.col("a") & ~F.col("b")).alias("n_only"))


@query("set03_vocabulary_union", "SELECT count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark UNION SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) FROM documents)")
def set03(spark: SparkSession, d: str) -> DataFrame:
    words = lambda t: table(spark, d, t).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)).alias("w"))
    return words("benchmark").unionByName(words("documents")).distinct().agg(F.count("*").alias("n"))


@query("set04_last_title_wins", "SELECT lang, arg_max(source, doc_id) AS source FROM documents GROUP BY lang")
def set04(spark: SparkSession, d: str) -> DataFrame:
    return ingest.last_per_key(table(spark, d, "documents").select("lang", "source", "doc_id"), "lang", "doc_id")


@query("prg01_course_to_programs", f"SELECT course, count(*) FILTER (WHERE rank = 0) AS core, count(*) FILTER (WHERE rank = 1) AS pick_one, count(*) FILTER (WHERE rank = 2) AS elective FROM (SELECT course, program, min({RANK}) AS rank FROM {LINKS} GROUP BY 1, 2) GROUP BY course")
def prg01(spark: SparkSession, d: str) -> DataFrame:
    rank = relations.requirement_rank(F.col("requirement"), F.col("one_of"))
    best = links(spark, d).groupBy("course", "program").agg(F.min(rank).alias("rank"))
    n = lambda k: F.count_if(F.col("rank") == k)
    return best.groupBy("course").agg(n(0).alias("core"), n(1).alias("pick_one"), n(2).alias("elective"))


@query("prg02_program_to_courses", f"SELECT program, course, min({RANK}) AS rank, bool_or(plan = 1) AS direct FROM {LINKS} GROUP BY 1, 2")
def prg02(spark: SparkSession, d: str) -> DataFrame:
    rank = relations.requirement_rank(F.col("requirement"), F.col("one_of"))
    return links(spark, d).groupBy("program", "course").agg(F.min(rank).alias("rank"), F.bool_or(F.col("plan") == 1).alias("direct"))


@query("prg03_permit", f"SELECT s_suppkey AS program, CASE WHEN s_acctbal < 0 THEN 'excluded' WHEN core THEN 'core' WHEN core IS NOT NULL THEN 'elective' ELSE 'neither' END AS answer FROM supplier LEFT JOIN (SELECT program, bool_or(requirement = 'core') AS core FROM {LINKS} WHERE course = 7 GROUP BY 1) ON program = s_suppkey")
def prg03(spark: SparkSession, d: str) -> DataFrame:
    owned = links(spark, d).filter("course = 7").groupBy("program").agg(F.min("requirement").alias("requirement"))
    df = table(spark, d, "supplier").select(F.col("s_suppkey").alias("program"), (F.col("s_acctbal") < 0).alias("excluded")).join(owned, "program", "left")
    return df.select("program", relations.permit(F.col("excluded"), F.col("requirement")).alias("answer"))


@query("prg04_find_program", "SELECT s_suppkey, s_name FROM supplier WHERE lower(s_name) LIKE '%supplier#0000000%' ORDER BY length(s_name), s_name LIMIT 10")
def prg04(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "supplier").filter(F.contains(F.lower("s_name"), F.lit("supplier#0000000"))).select("s_suppkey", "s_name")
    return df.orderBy(F.length("s_name"), "s_name").limit(10)


@query("prg05_plan_level_core", f"SELECT program, bool_or(plan > 4 AND requirement = 'core') AS hint FROM {LINKS} GROUP BY program")
def prg05(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).groupBy("program").agg(F.bool_or((F.col("plan") > 4) & (F.col("requirement") == "core")).alias("hint"))


@query("prg06_flags", f"SELECT course, course % 3 = 0 AS offered_s2, bool_or(l_returnflag = 'A') AS offered_s1 FROM {LINKS} GROUP BY course")
def prg06(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("course"), F.lit(True).alias("s2"))
    own = links(spark, d).groupBy("course").agg(F.bool_or(F.col("l_returnflag") == "A").alias("offered_s1"))
    return own.join(listed, "course", "left").select("course", F.coalesce("s2", F.lit(False)).alias("offered_s2"), "offered_s1")


@query("prg07_backfill_changes", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'PROMO' WHEN p_size < 3 THEN NULL ELSE p_type END AS new FROM part WHERE CASE WHEN p_size > 25 THEN 'PROMO' WHEN p_size < 3 THEN NULL ELSE p_type END IS DISTINCT FROM p_type")
def prg07(spark: SparkSession, d: str) -> DataFrame:
    new = F.when(F.col("p_size") > 25, F.lit("PROMO")).when(F.col("p_size") < 3, F.lit(None).cast("string")).otherwise(F.col("p_type"))
    return ingest.changed(table(spark, d, "part"), "p_type", new).select("p_partkey", F.col("_new").alias("new"))


@query("snk01_upsert", """WITH c AS (SELECT k AS p_partkey, arg_max(p_size, o) AS p_size FROM (SELECT l_partkey + 100 AS k, l_linenumber AS p_size, l_orderkey * 10 + l_linenumber AS o FROM lineitem) GROUP BY 1)
    SELECT coalesce(p.p_partkey, c.p_partkey) AS p_partkey, p_name, CASE WHEN c.p_partkey IS NOT NULL THEN c.p_size ELSE p.p_size END AS p_size FROM part p FULL JOIN c ON p.p_partkey = c.p_partkey""")
def snk01(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") + 100).alias("p_partkey"), F.col("l_linenumber").alias("p_size"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return ingest.upsert(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), rows, "p_partkey", "o")


@query("snk03_replace_children", f"SELECT program, course FROM {LINKS} WHERE program >= 3 GROUP BY ALL UNION ALL SELECT DISTINCT l_suppkey, l_partkey + 1 FROM lineitem WHERE l_suppkey < 3")
def snk03(spark: SparkSession, d: str) -> DataFrame:
    base = links(spark, d).select("program", "course").distinct()
    return ingest.replace_children(base, base.filter("program < 3").withColumn("course", F.col("course") + 1), "program")


@query("snk06_update_rowcount", "SELECT count(*) FILTER (WHERE vec_id IS NOT NULL) AS updated, count(*) FILTER (WHERE vec_id IS NULL) AS unmatched FROM labels LEFT JOIN embeddings ON doc_id = vec_id")
def snk06(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has"))
    return table(spark, d, "labels").join(vectors, "doc_id", "left").agg(F.count_if("has").alias("updated"), F.count_if(F.col("has").isNull()).alias("unmatched"))


@query("snk07_fill_missing", "SELECT doc_id, coalesce(embedding::DOUBLE[], CASE WHEN trim(coalesce(text, ''), ' ') <> '' THEN [length(text) % 7, length(text) % 11]::DOUBLE[] END) AS embedding FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def snk07(spark: SparkSession, d: str) -> DataFrame:
    """A caller's function makes the missing vectors: here of the length of a text."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    df = table(spark, d, "documents").select("doc_id", "text").join(vectors, "doc_id", "left")
    made = lambda x: F.array(*[(F.length(x) % n).cast("double") for n in (7, 11)])
    return ingest.fill_missing(df, "embedding", "text", made).select("doc_id", "embedding")


@query("snk09_incremental", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def snk09(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("src09_enum_domains", "SELECT array_to_string(list_sort(list(DISTINCT p_brand)), '|') AS brands, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS types FROM part")
def src09(spark: SparkSession, d: str) -> DataFrame:
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return table(spark, d, "part").agg(listed("p_brand").alias("brands"), listed("p_type").alias("types"))


@query("src16_latest_snapshot", "SELECT l_orderkey, arg_max(l_partkey, (l_shipdate, l_linenumber, l_partkey)) AS l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def src16(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return ingest.latest_snapshot(table(spark, d, "lineitem"), wanted, "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey"], "l_partkey")


@query("win01_rank", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def win01(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", rank.alias("rank"))


@query("extra_rollup_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 6) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def extra_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("q"))
