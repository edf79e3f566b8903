"""Queries of text, dates, JSON, evaluation and request limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import derive, text
from lodestone.operators import evaluation
from lodestone.registry import query, table



def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("str01_lang_detect", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[éèêçäöüßñ]') THEN 'marked' ELSE 'plain' END AS script, 'en' AS lang FROM conversations WHERE NOT regexp_matches(text, '[\\x{4e00}-\\x{9fff}]')")
def str01(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("text").rlike("[éèêçäöüßñ]"), "marked").otherwise("plain").alias("script"), text.detect_lang(F.col("text")).alias("lang"))
    return df.filter("lang = 'en'")


@query("str02_code_extract", "SELECT doc_id, upper(regexp_extract(s, '(?:^|[^A-Za-z0-9])([A-Za-z]{4}[0-9]{4})(?:[^A-Za-z0-9]|$)', 1)) AS code FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'see abcd' || lpad(doc_id::VARCHAR, 4, '0') || '.' ELSE 'xabcd' || lpad(doc_id::VARCHAR, 4, '0') END AS s FROM documents)")
def str02(spark: SparkSession, d: str) -> DataFrame:
    number = F.lpad(F.col("doc_id").cast("string"), 4, "0")
    s = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("see abcd"), number, F.lit("."))).otherwise(F.concat(F.lit("xabcd"), number))
    return docs(spark, d).select("doc_id", text.course_code(s).alias("code"))


TITLES = ["Industry Research Placement", "Teaching Research Methods", "Honours Research Project", "Dissertation Seminar", "Laboratory Skills in Genetic Research", "Fieldwork in Geology", "Capstone", None]
TASKS = ["In-Semester Exam", "Quiz", "Final Exam", "End of Semester Test", "Midway reflection", "Group essay", "Teamwork diary", "Contest", None]


def assessments(spark: SparkSession, d: str) -> DataFrame:
    """Orders as courses: a title by number, and an assessment for each line, whose task goes by its part."""
    pick = lambda xs, n: F.get(F.array(*[F.lit(x).cast("string") for x in xs]), (F.col(n) % len(xs)).cast("int"))
    category = F.when(F.col("l_partkey") % len(TASKS) == 4, "Examination").when(F.col("l_returnflag") == "A", "Thesis, thesis ").when(F.col("l_returnflag") == "R", "Project, Thesis").otherwise("Essay")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(pick(TASKS, "l_partkey").alias("task"), category.alias("category"))).alias("a"))
    orders = table(spark, d, "orders").select("o_orderkey", pick(TITLES, "o_orderkey").alias("title"))
    return orders.join(rows, orders.o_orderkey == rows.l_orderkey, "left").select("o_orderkey", "title", "a")


@query("str03_course_type", """SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 5) THEN 'placement' WHEN o_orderkey % 8 = 3 OR bool_or(l_returnflag = 'A' AND l_partkey % 9 <> 4) THEN 'thesis' WHEN o_orderkey % 8 = 2 THEN 'research' ELSE 'coursework' END AS course_type FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def str03(spark: SparkSession, d: str) -> DataFrame:
    return assessments(spark, d).select("o_orderkey", derive.course_type(F.col("title"), F.col("a")).alias("course_type"))


@query("str04_midterm", """SELECT o_orderkey, CASE WHEN bool_or(l_partkey % 9 = 0) THEN 'has' WHEN bool_or(l_partkey % 9 IN (1, 4)) THEN 'unknown' ELSE 'none' END AS midterm,
    CASE WHEN count(l_orderkey) = 0 THEN 'unknown' WHEN bool_or(l_partkey % 9 = 5) THEN 'has' ELSE 'none' END AS grouped FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def str04(spark: SparkSession, d: str) -> DataFrame:
    return assessments(spark, d).select("o_orderkey", derive.midterm_status(F.col("a")).alias("midterm"), derive.group_status(F.col("a")).alias("grouped"))


@query("str06_period", "SELECT o_orderkey, CASE WHEN month(o_orderdate) <= 6 THEN 'S1' ELSE 'S2' END AS semester, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def str06(spark: SparkSession, d: str) -> DataFrame:
    period = F.concat(F.lit("Semester "), F.when(F.month("o_orderdate") <= 6, "1").otherwise("2"), F.lit(", "), F.year("o_orderdate").cast("string"))
    semester, year = derive.semester_and_year(period)
    return table(spark, d, "orders").select("o_orderkey", semester.alias("semester"), year.alias("year"))


@query("str08_str09_chunk", "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens, len(list_filter(list_transform(range(0, greatest(length(text), 1), 360), lambda i: trim(substring(text, CAST(i + 1 AS INTEGER), 400), ' ')), lambda x: x <> '')) AS chunks FROM documents")
def str08(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.approx_tokens(F.col("text")).alias("tokens"), F.size(text.hard_split(F.col("text"), 100, 10)).cast("long").alias("chunks"))


@query("str10_linear_tables", "SELECT p_partkey, 'name, size' || chr(10) || p_name || ', ' || p_size AS lines FROM part")
def str10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.linear_tables(F.concat(F.lit("| name | size |\n|---|---|\n| "), "p_name", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |"))).alias("lines"))


@query("str14_squeeze", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS h FROM documents")
def str14(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.md5(text.squeezed(F.col("text"))).alias("h"))


STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
ENTITIES = f"list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]+'), lambda x: length(x) >= 4 AND x NOT IN ({STOP}))"


@query("str15_entities", f"SELECT item_id, len(list_distinct({ENTITIES})) AS n FROM benchmark")
def str15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.size(text.entity_tokens(F.col("text"))).cast("long").alias("n"))


@query("str16_year_range", "SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1998 THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders")  # what touches letters or digits is no year
def str16(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("code 120199 x, 2031a, in 1999 or "), F.date_format("o_orderdate", "yyyy"))
    return table(spark, d, "orders").select("o_orderkey", text.out_of_range_year(said, 1998, 2028).alias("year"))


@query("str17_citation_guard", "SELECT conv_id, turn, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda l: len(list_filter(regexp_extract_all(l, '[A-Z][a-z]+'), lambda w: w NOT IN ('The', 'De', 'Et'))) = 0), chr(10))) AS h FROM conversations")
def str17(spark: SparkSession, d: str) -> DataFrame:
    allowed = F.array(*map(F.lit, ["The", "De", "Et"]))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.guard_citations(F.col("text"), allowed, "([A-Z][a-z]+)")).alias("h"))


@query("str18_empty_answer", "SELECT conv_id, turn, length(ltrim(text, '-*• ' || chr(10) || chr(9))) < 8 OR lower(text) LIKE '%tion%' AS empty FROM conversations")
def str18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.is_empty_answer(F.col("text"), "tion").alias("empty"))


@query("str19_format_number", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS q FROM lineitem")
def str19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.format_number(F.col("l_quantity")).alias("q"))


@query("str20_fact_lines", "SELECT p_partkey, p_name || ' (' || p_brand || '), size ' || p_size AS line FROM part")
def str20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.format_string("%s (%s), size %d", "p_name", "p_brand", "p_size").alias("line"))


@query("str21_source_block", "SELECT url, arg_min(page_id, page_id) AS page_id FROM pages GROUP BY url")
def str21(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy("url").agg(F.min_by("page_id", "page_id").alias("page_id"))


@query("str22_url_parts", "SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*/([^/?#]*)', 1) AS segment FROM pages")
def str22(spark: SparkSession, d: str) -> DataFrame:
    host, segment = text.url_parts(F.col("url"))
    return table(spark, d, "pages").select("page_id", host.alias("host"), segment.alias("segment"))


@query("str23_sha1", "SELECT page_id, sha1(url) AS url_hash, sha1(html) AS content_hash FROM pages")
def str23(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha1("url").alias("url_hash"), F.sha1("html").alias("content_hash"))


@query("str25_strip_reasoning", "SELECT conv_id, turn, md5(trim(text)) AS h FROM conversations")
def str25(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.strip_reasoning(F.concat(F.lit("<reasoning>a\nb</reasoning> "), F.col("text")))).alias("h"))


@query("str28_normalise", "SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[.,;:]', '', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS h FROM conversations")
def str28(spark: SparkSession, d: str) -> DataFrame:
    # Engines upper-case letters such as the sharp s differently: A-Z here.
    upper = F.translate(F.col("text"), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.squeezed(F.regexp_replace(upper, "[.,;:]", ""))).alias("h"))


@query("str29_bare_dates", "SELECT o_orderkey, 1 AS n, CASE WHEN o_orderkey % 2 = 0 THEN '3月' ELSE '11 月' END AS month FROM orders")
def str29(spark: SparkSession, d: str) -> DataFrame:
    """A month with its year beside it, and one far from any year."""
    month = F.when(F.col("o_orderkey") % 2 == 0, "3月").otherwise("11 月")
    said = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("年2月, and then, a good deal later, hand in by "), month, F.lit(" at noon"))
    found = table(spark, d, "orders").select("o_orderkey", text.bare_dates(said).alias("x"))
    return found.select("o_orderkey", F.size("x").alias("n"), F.regexp_extract(F.get("x", F.lit(0)), "([0-9]+ *月)", 1).alias("month"))


@query("dat01_span_days", "SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate, l_shipdate) >= 240 AS long FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P'")
def dat01(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    df = table(spark, d, "lineitem").join(orders, "l_orderkey", "left")
    period = F.concat(F.lit("("), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" - "), F.date_format("l_shipdate", "dd/MM/yyyy"), F.lit(")"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", derive.year_long(period).alias("long"))


@query("dat02_staleness", "SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '1998-08-02') > 180 AS stale FROM orders")
def dat02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", derive.stale(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1998-08-02").cast("date")).alias("stale"))


@query("dat03_time_keys", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) // 60000000 AS minute FROM events")
def dat03(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd").alias("day"), F.floor(F.unix_seconds(ts) / 60).alias("minute"))


@query("dat04_slots", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 'S1 ' ELSE 'S2 ' END || (l_linenumber // 2 + 2024) AS slot, greatest(1, CAST(ceil(l_quantity / 8) AS INTEGER), l_linenumber + 1) AS needed FROM lineitem")
def dat04(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", derive.slot_of("S1", n, 2024).alias("slot"), derive.slots_needed(F.col("l_quantity"), n).alias("needed"))


@query("mth01_capped", "SELECT l_orderkey, l_linenumber, l_partkey, least(l_quantity, 30.0) AS counted, l_quantity > 30 AS over FROM lineitem")
def mth01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.least("l_quantity", F.lit(30.0)).alias("counted"), (F.col("l_quantity") > 30).alias("over"))


@query("mth02_precision_recall", "SELECT (count(*) FILTER (WHERE f AND w))::DOUBLE / count(*) FILTER (WHERE f) AS precision, (count(*) FILTER (WHERE f AND w))::DOUBLE / count(*) FILTER (WHERE w) AS recall, bool_and(f = w) AS exact FROM (SELECT n_chars > 500 AS f, quality = 1 AS w FROM documents JOIN labels USING (doc_id))")
def mth02(spark: SparkSession, d: str) -> DataFrame:
    df = docs(spark, d).select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return evaluation.precision_recall(df.filter("n_chars > 500"), df.filter("quality = 1"), "doc_id")


@query("arr02_multiset_equal", "SELECT l_orderkey, list_sort(list(round_even(l_quantity, 0))) = list_sort(list(round_even(l_quantity + CASE WHEN l_linenumber > 6 THEN 1 ELSE 0 END, 0))) AS same FROM lineitem GROUP BY 1")
def arr02(spark: SparkSession, d: str) -> DataFrame:
    own, claimed = F.bround("l_quantity", 0), F.bround(F.col("l_quantity") + F.when(F.col("l_linenumber") > 6, 1).otherwise(0), 0)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.array_sort(F.collect_list(own)) == F.array_sort(F.collect_list(claimed))).alias("same"))


@query("arr03_equivalence_key", "SELECT l_orderkey, array_to_string(list_sort(list(l_partkey::VARCHAR)), '|') AS key FROM lineitem GROUP BY 1")
def arr03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.col("l_partkey").cast("string"))), "|").alias("key"))


@query("jsn11_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def jsn11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query("map01_lookup", "SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 5 ELSE 0 END AS weight FROM events")
def map01(spark: SparkSession, d: str) -> DataFrame:
    weights = F.create_map(*[F.lit(x) for pair in {"view": 1, "click": 2, "purchase": 5}.items() for x in pair])
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(weights, F.col("event_type")), F.lit(0)).alias("weight"))


SCORED = "(SELECT doc_id, quality = 1 AS pos, least(n_chars, 4000) / 4000.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
SWEPT = f"(SELECT step / 100.0::DOUBLE AS threshold, count(*) FILTER (WHERE pos AND round(score * 100, 6) >= step) AS passed, count(*) FILTER (WHERE NOT pos AND round(score * 100, 6) < step) AS blocked, (count(*) FILTER (WHERE pos AND round(score * 100, 6) >= step) + count(*) FILTER (WHERE NOT pos AND round(score * 100, 6) < step))::DOUBLE / count(*) AS accuracy FROM range(5, 91) t(step), {SCORED} GROUP BY step)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "labels").join(docs(spark, d).select("doc_id", "n_chars"), "doc_id")
    return df.select("doc_id", (F.col("quality") == 1).alias("pos"), (F.least("n_chars", F.lit(4000)) / 4000.0).alias("score"))


@query("evl01_threshold_sweep", f"SELECT threshold, passed, blocked, round(accuracy, 6) AS accuracy FROM {SWEPT}")
def evl01(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.sweep(scored(spark, d), "score", F.col("pos"), 5, 90, 100.0).withColumn("accuracy", F.round("accuracy", 6))


@query("evl02_overlap", f"SELECT count(*) FILTER (WHERE NOT pos AND score >= low) AS negatives_over, count(*) FILTER (WHERE pos AND score <= high) AS positives_under FROM (SELECT *, min(score) FILTER (WHERE pos) OVER () AS low, max(score) FILTER (WHERE NOT pos) OVER () AS high FROM {SCORED})")
def evl02(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.overlap(scored(spark, d), "score", F.col("pos"))


FLOORS = f"(SELECT step / 1000.0::DOUBLE AS floor, count(*) FILTER (WHERE pos AND round(score * 1000, 6) >= step) AS kept, count(*) FILTER (WHERE NOT pos AND round(score * 1000, 6) < step) AS cut, count(*) FILTER (WHERE pos) AS n_signals, count(*) AS n FROM range(1, 901) t(step), {SCORED} GROUP BY step)"


@query("evl03_floor", f"""SELECT (SELECT max(floor) FROM {FLOORS} WHERE kept = n_signals) AS max_keep, arg_min(floor, (-(kept + cut), floor)) AS best, arg_min(kept, (-(kept + cut), floor)) AS kept, arg_min(cut, (-(kept + cut), floor)) AS cut FROM {FLOORS}""")
def evl03(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.floors(evaluation.sweep(scored(spark, d), "score", F.col("pos"), 1, 900, 1000.0), scored(spark, d).filter("pos"))


@query("evl04_separability", f"WITH s AS (SELECT * FROM {SCORED}), c AS (SELECT DISTINCT score AS cut FROM s), a AS (SELECT c.cut, count(*) FILTER (WHERE pos = (s.score >= c.cut)) AS ok, count(*) AS n FROM c, s GROUP BY 1) SELECT round(arg_max(cut, (ok, -cut)), 9) AS cut, round(max(ok / n), 6) AS accuracy FROM a")
def evl04(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.separability(scored(spark, d), "score", F.col("pos")).select(F.round("cut", 9).alias("cut"), F.round("accuracy", 6).alias("accuracy"))


@query("win05_rate_limit", "SELECT event_id, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def win05(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.streaming.limiter import window_allowed

    return window_allowed(table(spark, d, "events"), "user_id", 3600, 2).select("event_id", "allowed")


@query("stm02_daily_cap", "SELECT event_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) <= 100 AS allowed FROM events")
def stm02(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.streaming.limiter import daily_allowed

    return daily_allowed(table(spark, d, "events"), 100).select("event_id", "allowed")


@query("stm04_gate_order", """WITH a AS (SELECT *, event_type <> 'error' AS human, row_number() OVER (PARTITION BY user_id, event_type <> 'error', epoch_us(ts) // 3600000000 ORDER BY ts, event_id) <= 2 AS ip_ok FROM events),
    b AS (SELECT *, row_number() OVER (PARTITION BY human AND ip_ok, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) <= 100 AS day_ok FROM a)
    SELECT event_id, CASE WHEN NOT human THEN 'not_human' WHEN NOT ip_ok THEN 'ip' WHEN NOT day_ok THEN 'day' ELSE 'allowed' END AS verdict FROM b""")
def stm04(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.streaming.limiter import gates

    return gates(table(spark, d, "events"), F.col("event_type") != "error", 3600, 2, 100).select("event_id", "verdict")


@query("stm05_client_ip", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'cf' || user_id END, CASE WHEN event_id % 3 = 1 THEN 'x' || user_id END, 'unknown') AS ip FROM events")
def stm05(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.streaming.limiter import client_ip

    k, user = F.col("event_id") % 3, F.col("user_id").cast("string")
    cf, xff = F.when(k == 0, F.concat(F.lit(" cf"), user)), F.when(k == 1, F.concat(F.lit("x"), user, F.lit(", proxy")))
    return table(spark, d, "events").select("event_id", client_ip(cf, xff, F.lit("")).alias("ip"))


@query("stm09_spike_windows", "SELECT user_id, epoch_us(ts) // 300000000 AS slot, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 2")
def stm09(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.streaming.limiter import spikes

    return spikes(table(spark, d, "events"), "user_id", 300, 2).select("user_id", F.floor(F.unix_seconds("begin") / 300).alias("slot"), "n")


@query("extra_sessions", "SELECT user_id, sum(new) AS sessions FROM (SELECT user_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events) GROUP BY 1")
def extra_sessions(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.groupBy("user_id", F.session_window("ts", "30 minutes")).count().groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("sim16_timetable", "SELECT l_orderkey, l_linenumber % 4 AS slot, round(sum(l_quantity), 6) AS units, sum(l_quantity) > 60 AS over, bool_or(l_linenumber % 2 <> CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END) AS misplaced FROM lineitem GROUP BY 1, 2")
def sim16(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").withColumns({"slot": F.col("l_linenumber") % 4, "kind": F.when(F.col("l_returnflag") == "A", 0).otherwise(1)})
    return df.groupBy("l_orderkey", "slot").agg(F.round(F.sum("l_quantity"), 6).alias("units"), (F.sum("l_quantity") > 60).alias("over"), F.bool_or(F.col("l_linenumber") % 2 != F.col("kind")).alias("misplaced"))
