"""Queries of loads, sinks and page sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import ingest, relations, rules
from lodestone.plans.questions import asked, own_codes, own_codes_sql, stated
from lodestone.registry import query, table
from lodestone.sources import files
from lodestone.sources.files import scratch


@query("snk02_partial_upsert", "SELECT c_custkey, c_name, CASE WHEN n IS NULL THEN c_acctbal ELSE n END AS c_acctbal, c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def snk02(spark: SparkSession, d: str) -> DataFrame:
    """Programs take new units; their other columns stay."""
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("c_acctbal")).withColumn("at", F.lit(1))
    return ingest.upsert(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), new, "c_custkey", "at")


def chunked(spark: SparkSession, d: str, base: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    base = base if base is not None else table(spark, d, "labels").select("doc_id", F.lit("old").alias("text"), F.lit(None).cast("int").alias("label"))
    rows = table(spark, d, "documents").select("doc_id", F.lit("new").alias("text"), F.lit(1).alias("at"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return ingest.with_vectors(base, rows, vectors, "doc_id", "at")


@query("snk04_vector_upsert", "SELECT coalesce(l.doc_id, x.doc_id) AS doc_id, CASE WHEN x.doc_id IS NOT NULL THEN 'new' ELSE 'old' END AS text, x.label FROM labels l FULL JOIN (SELECT doc_id, label FROM documents JOIN embeddings ON doc_id = vec_id) x ON l.doc_id = x.doc_id")
def snk04(spark: SparkSession, d: str) -> DataFrame:
    return chunked(spark, d)[0]


@query("snk04_skipped", "SELECT count(vec_id) AS loaded, count(*) - count(vec_id) AS skipped FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def snk04_skipped(spark: SparkSession, d: str) -> DataFrame:
    return chunked(spark, d)[1]


@query("snk05_replace_guides", """SELECT l_suppkey AS code, CAST(year(l_shipdate) AS INTEGER) AS year, CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey || '_' || year(l_shipdate) || '-' || (row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate) ORDER BY l_orderkey * 10 + l_linenumber, l_partkey) - 1) ELSE 'old' END AS id, l_orderkey * 10 + l_linenumber AS at FROM (SELECT DISTINCT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem)""")
def snk05(spark: SparkSession, d: str) -> DataFrame:
    """Guides by code and year: those of even codes come anew and are numbered, the others stay."""
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").distinct()
    rows = lines.select(F.col("l_suppkey").alias("code"), F.year("l_shipdate").alias("year"), F.lit("old").alias("id"), at.alias("at"), F.struct(at, "l_partkey").alias("o"))
    return ingest.replace_groups(rows.drop("o"), rows.filter("code % 2 = 0").drop("id"), ["code", "year"], "o", "id")


@query("snk08_markdown", "SELECT CAST(-2 AS BIGINT) AS place, '| n_name | n_regionkey |' AS line UNION ALL SELECT -1, '|---|---|' UNION ALL SELECT n_nationkey, '| ' || n_name || ' | ' || n_regionkey || ' |' FROM nation")
def snk08(spark: SparkSession, d: str) -> DataFrame:
    return files.markdown_lines(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


@query("src17_offerings", "SELECT 'X-' || p_partkey AS offering_id, 'St  Lucia' AS location, 'Online' AS mode FROM part WHERE false UNION ALL SELECT 'X-' || p_partkey, 'St Lucia', 'Online' FROM part WHERE p_size % 2 = 1 AND p_partkey % 3 = 0")
def src17(spark: SparkSession, d: str) -> DataFrame:
    href = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("https://x.example/course-profiles/X-"), F.col("p_partkey").cast("string"), F.lit("/"))).otherwise("https://x.example/archive/1")
    period = F.concat(F.lit("Semester "), F.when(F.col("p_size") % 2 == 1, "1").otherwise("2"), F.lit(", 2025"))
    rows = table(spark, d, "part").select(href.alias("href"), F.array(period, F.lit(" St\n Lucia"), F.lit("Online")).alias("cells"))
    return files.offerings(rows, r"Semester 1, 20\d\d", "st lucia", "ONLINE")


@query("src12_sitemaps", "SELECT 'https://x.example/' || p_partkey AS loc, CASE WHEN p_size > 10 THEN '2025-01-01' ELSE '' END AS lastmod FROM part WHERE p_partkey % 10 < 9")
def src12(spark: SparkSession, d: str) -> DataFrame:
    """Ten sitemaps of parts; an index names nine of them, itself and one that can't be read."""
    part = table(spark, d, "part").select((F.col("p_partkey") % 10).alias("n"), F.concat(F.lit("<url><loc> https://x.example/"), F.col("p_partkey").cast("string"), F.lit("</loc>"), F.when(F.col("p_size") > 10, "<lastmod>2025-01-01</lastmod>").otherwise(""), F.lit("</url>")).alias("u"))
    maps = part.groupBy("n").agg(F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list("u"), ""), F.lit("</urlset>")).cast("binary").alias("body"))
    maps = maps.select(F.concat(F.lit("map"), F.col("n").cast("string")).alias("url"), "body")
    names = [*(f"map{i}" for i in range(9)), "index", "broken"]
    other = [("index", bytearray(("<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in names) + "</sitemapindex>").encode())), ("broken", bytearray(b"<urlset"))]
    seeds = spark.createDataFrame([("index",)], "url string")
    return files.expanded_sitemaps(seeds, maps.unionByName(spark.createDataFrame(other, "url string, body binary")))


COURSE_SQL = """SELECT p_partkey, 'ABCD' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') AS code, p_name AS title, p_size::VARCHAR AS units, 'EFGH1000|IJKL2000' AS incompatible, 'EFGH1000 or IJKL2000' AS prerequisite,
    CAST(2 AS BIGINT) AS n_items, 60.0::DOUBLE AS weight, true AS hurdle, 'Sorting' AS topic, 'L01|L2' AS outcomes FROM part"""


@query("src11_course_fields", COURSE_SQL)
def src11(spark: SparkSession, d: str) -> DataFrame:
    """Parts as course pages, and what is read of them."""
    number = F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")
    html = F.concat(*[x if isinstance(x, F.Column) else F.lit(x) for x in (
        "<html><h1>", F.col("p_name"), " (ABCD", number, ")</h1><dl><dt>Units:</dt><dd>", F.col("p_size").cast("string"), "</dd><dt>Location</dt><dd>Here</dd></dl>",
        "<h3>Incompatible</h3><p>You can't take these</p><p>EFGH1000 and IJKL2000</p><h3>Prerequisites</h3><p>You'll need to complete the following: EFGH1000 or IJKL2000</p><h3>Recommended prerequisite</h3><p>MNOP1000</p>",
        "<table><tr><th>Category</th><th>Assessment task</th><th>Weight</th></tr><tr><td>Examination</td><td>Final <b>Hurdle</b></td><td>60% (12)</td></tr><tr><td>Essay</td><td>Paper</td><td>pass</td></tr><tr><td>x</td></tr></table>",
        "<table><tr><th>Period</th><th>Activity type</th><th>Topic</th></tr><tr><td>Week 1</td><td>Lecture</td><td>Week 1 Lectures Sorting. Learning outcomes: L01, L2</td></tr></table></html>",
    )])
    c = F.col("course")
    df = files.course_pages(table(spark, d, "part").withColumn("html", html), "p_partkey")
    first = c["assessments"][0]
    return df.select(
        F.col("offering_id").cast("long").alias("p_partkey"), c["code"].alias("code"), c["title"].alias("title"), c["fields"]["Units"].alias("units"), F.array_join(c["incompatible"], "|").alias("incompatible"),
        c["prerequisite"].alias("prerequisite"), F.size(c["assessments"]).cast("long").alias("n_items"), first["weight"].alias("weight"), first["hurdle"].alias("hurdle"), c["activities"][0]["topic"].alias("topic"),
        F.array_join(c["activities"][0]["learning_outcomes"], "|").alias("outcomes"),
    )


@query("srt05_listed_programs", "SELECT s_suppkey, s_nationkey % 3 AS rank, CAST(row_number() OVER (PARTITION BY s_nationkey % 3 ORDER BY nullif(s_name, 'Supplier#000000003') NULLS LAST, s_suppkey) AS INTEGER) AS place FROM supplier")
def srt05(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).alias("rank"), F.nullif("s_name", F.lit("Supplier#000000003")).alias("title"))
    return relations.listed_programs(rows, "rank", "title", "s_suppkey").select("s_suppkey", "rank", "place")


@query("str20_totals", "SELECT p_brand, 'Courses (' || n || CASE WHEN n > least(n, 5) THEN ' in total, listing 5 below):' ELSE ' in total):' END AS line FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def str20_totals(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return counts.select("p_brand", text.total_line(F.col("n"), F.least("n", F.lit(5))).alias("line"))


@query("str20_course_lines", "SELECT p_partkey, '- C' || p_partkey || ': ' || CASE WHEN p_size % 3 = 0 THEN 'no offering' ELSE array_to_string(list_filter(['name=' || p_name, CASE WHEN p_size % 3 = 2 THEN 'size=' || p_size END], lambda x: x IS NOT NULL), ', ') END AS line FROM part")
def str20_lines(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("p_size") % 3 != 0, F.col("p_name"))
    size = F.when(F.col("p_size") % 3 == 2, F.concat(F.lit("size="), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", text.course_line(F.concat(F.lit("C"), F.col("p_partkey").cast("string")), title, [size]).alias("line"))


@query("str21_source_lines", "SELECT doc_id % 7 AS answer, array_to_string(list('- ' || title || ': ' || url ORDER BY first), chr(10)) AS block FROM (SELECT page_id % 7 AS doc_id, url, min(page_id) AS first, arg_min('page ' || page_id, page_id) AS title FROM pages GROUP BY 1, 2) GROUP BY 1")
def str21_lines(spark: SparkSession, d: str) -> DataFrame:
    """The sources of an answer, a line a url, with the title that came first."""
    rows = table(spark, d, "pages").select((F.col("page_id") % 7).alias("answer"), "url", "page_id", F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"))
    one = rows.groupBy("answer", "url").agg(F.min("page_id").alias("first"), F.min_by("title", "page_id").alias("title"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("first", F.concat(F.lit("- "), "title", F.lit(": "), "url").alias("line")))), lambda x: x["line"])
    return one.groupBy("answer").agg(F.array_join(lines, "\n").alias("block"))


LINKS = ["https://y.example/a#b", "/root?x#y", "next", "//z.example/c"]


@query("str22_joined_urls", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://y.example/a' WHEN 1 THEN 'https://x.example/root?x' WHEN 2 THEN 'https://x.example/p/' || p_size || '/next' ELSE 'https://z.example/c' END AS url FROM part")
def str22_joined(spark: SparkSession, d: str) -> DataFrame:
    base = F.concat(F.lit("https://x.example/p/"), F.col("p_size").cast("string"), F.lit("/page.html?q=/1"))
    link = F.get(F.array(*map(F.lit, LINKS)), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, d, "part").select("p_partkey", text.joined_url(base, link).alias("url"))


def written(spark: SparkSession, df: DataFrame, name: str) -> str:
    """df (one column, value) as lines of text in a folder of its own."""
    path = files.scratch(spark, name)
    df.write.text(path)
    return path


@query("src01_json_lines", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def src01(spark: SparkSession, d: str) -> DataFrame:
    """Nations as JSON lines, with a blank line after each."""
    lines = table(spark, d, "nation").select(F.concat(F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))), F.lit("\n  ")).alias("value"))
    return files.json_lines(spark, written(spark, lines, "json-lines"), "id int, name string")


@query("src02_word_set", "SELECT DISTINCT unnest(regexp_extract_all(p_name, '[^ \\t\\n]+')) AS word FROM part")
def src02(spark: SparkSession, d: str) -> DataFrame:
    there = files.word_set(spark, written(spark, table(spark, d, "part").select(F.col("p_name").alias("value")), "words"))
    return there.unionByName(files.word_set(spark, files.scratch(spark, "nothing")))


@query("src03_vocabulary", "SELECT p_type AS word, count(*) AS freq FROM part GROUP BY 1")
def src03(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "vocabulary")
    files.write_table(table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")), path)
    return files.vocabulary(spark, path)


@query("src04_overrides", "SELECT p_brand AS id, count(*) AS n FROM part GROUP BY 1")
def src04(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).coalesce(1)
    line = lambda n: F.to_json(F.struct(F.col("p_brand").alias("id"), n.alias("n")))
    lines = counts.select(F.concat(line(F.col("n") + 1), F.lit("\n"), line(F.col("n"))).alias("value"))
    return files.overrides(spark, written(spark, lines, "overrides"), "id", "n long")


@query("src08_url_list", "SELECT DISTINCT url, CASE WHEN contains(url, ',') THEN 'comma' ELSE 'plain' END AS kind FROM pages")
def src08(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "urls")
    files.write_url_list(table(spark, d, "pages").select("url", F.when(F.contains("url", F.lit(",")), "comma").otherwise("plain").alias("kind")).distinct(), path)
    return files.url_list(spark, path)


@query("src10_embedded_object", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '{"n": ' || p_size || '}' END AS object FROM part""")
def src10(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<script>var a = 1; window.Data = {\"n\": "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "}; more = {}").otherwise(" no end"), F.lit("</script>"))
    return table(spark, d, "part").select("p_partkey", files.embedded_object(html, "Data").alias("object"))


@query("src05_guides", "SELECT 'ABCD' || lpad(n_nationkey::VARCHAR, 4, '0') AS code, n_name AS note, 'about ' || n_name AS body FROM nation")
def src05(spark: SparkSession, d: str) -> DataFrame:
    """A guide a nation, in a file of its name; a file of another name is none."""
    code = F.concat(F.lit("ABCD"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0"))
    rows = table(spark, d, "nation").select(code.alias("code"), F.concat(F.lit("---\ncode: "), code, F.lit("\nnote: "), "n_name", F.lit("\n---\nabout "), "n_name").alias("body"))
    found = files.parsed_guides(rows.select(F.concat("code", F.lit("_2025.md")).alias("name"), "body").unionByName(rows.select(F.lit("README.md").alias("name"), F.lit("none").alias("body"))))
    return found.select(F.variant_get(files.front_variant(F.col("front_text")), "$.code", "string").alias("code"), F.col("front")["note"].alias("note"), "body")


BIG = "a" * 70
MARKDOWN = ["# One\nshort text\n## Two\nmore", f"## Big\n{BIG}", f"intro words here\n### Sub\n{'b' * 30}", "## Only\n\n", None]


@query("str12_packed_sections", stated("headings VARCHAR, sizes VARCHAR", [("One", "16"), ("Big|Big|Big", "40|38|6"), ("|Sub", "16|30"), ("", ""), ("", "")]))
def str12(spark: SparkSession, d: str) -> DataFrame:
    df = asked(spark, d, _text=MARKDOWN).withColumn("_title", F.lit(""))
    found = files.chunks(df, "p_partkey", most=10, least=1, overlap=2)
    parts = F.array_sort(F.collect_list(F.struct("chunk_id", "heading", F.length("text").cast("string").alias("n"))))
    per_page = found.groupBy(F.col("id").cast("long").alias("p_partkey")).agg(parts.alias("x"))
    joined = lambda k: F.coalesce(F.array_join(F.transform("x", lambda p: p[k]), "|"), F.lit(""))
    return df.select("p_partkey").join(per_page, "p_partkey", "left").select("p_partkey", joined("heading").alias("headings"), joined("n").alias("sizes"))


PREREQUISITES = ["(OBOE2200 or 2300) and HARP3100", "OBOE2200, HARP3100", "ask the teacher", None, "HARP3100 + OBOE2200 or LUTE1000."]


def prerequisites(spark: SparkSession, d: str) -> DataFrame:
    """Parts with what each must have done before: its own codes."""
    return asked(spark, d, said=PREREQUISITES).withColumn("said", own_codes(F.col("said")))


@query("str07_expanded_codes", own_codes_sql(stated("expanded VARCHAR", [("(OBOE2200 or OBOE2300) and HARP3100",), ("OBOE2200, HARP3100",), ("ask the teacher",), ("",), ("HARP3100 + OBOE2200 or LUTE1000.",)]), "expanded"))
def str07(spark: SparkSession, d: str) -> DataFrame:
    return prerequisites(spark, d).select("p_partkey", rules.expanded_codes(F.col("said")).alias("expanded"))


@query("jsn08_prerequisite_trees", own_codes_sql(stated("tree VARCHAR", [
    ('{"op": "and", "of": [{"op": "or", "of": [{"op": "is", "of": "OBOE2200"}, {"op": "is", "of": "OBOE2300"}]}, {"op": "is", "of": "HARP3100"}]}',), ('{"op": "and", "of": [{"op": "is", "of": "OBOE2200"}, {"op": "is", "of": "HARP3100"}]}',),
    ('{"op": "raw", "of": "ask the teacher"}',), (None,), ('{"op": "or", "of": [{"op": "and", "of": [{"op": "is", "of": "HARP3100"}, {"op": "is", "of": "OBOE2200"}]}, {"op": "is", "of": "LUTE1000"}]}',),
]), "tree"))
def jsn08(spark: SparkSession, d: str) -> DataFrame:
    return prerequisites(spark, d).select("p_partkey", rules.prerequisite_trees(F.col("said")).alias("tree"))


@query("jsn09_satisfied", own_codes_sql(stated("ok BOOLEAN, said VARCHAR", [(True, None), (True, None), (True, "check: ask the teacher"), (True, None), (True, None)]).replace("CAST(v.ok AS BOOLEAN) AS ok", "v.k IN (2, 3) OR p_size % 2 = 0 AS ok").replace("CAST(v.said AS VARCHAR) AS said", "CASE WHEN v.k IN (0, 1) AND p_size % 2 = 1 THEN 'HARP3100' WHEN v.k = 4 AND p_size % 2 = 1 THEN 'HARP3100 or LUTE1000' ELSE v.said END AS said"), "said"))
def jsn09(spark: SparkSession, d: str) -> DataFrame:
    """Who has OBOE2200, and where a part's size is even HARP3100 too."""
    have = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("OBOE2200"), F.lit("HARP3100"))).otherwise(F.array(F.lit("OBOE2200")))
    df = prerequisites(spark, d).join(table(spark, d, "part").select("p_partkey", F.transform(have, own_codes).alias("have")), "p_partkey")
    return df.select("p_partkey", rules.satisfactions(F.col("said"), F.col("have")).alias("x")).select("p_partkey", "x.ok", "x.said")


FORMULAS = ["Part A AND ( Part B OR Part C )", "Part A AND", "16 units of Part A", None]


@query("jsn10_formula_trees", stated("tree VARCHAR", [('{"op": "and", "of": [{"op": "is", "of": "Part A"}, {"op": "or", "of": [{"op": "is", "of": "Part B"}, {"op": "is", "of": "Part C"}]}]}',), (None,), (None,), (None,)]).replace("CAST(v.tree AS VARCHAR) AS tree", "replace(CAST(v.tree AS VARCHAR), 'Part A', 'Part ' || chr(CAST(68 + p_partkey % 20 AS INTEGER))) AS tree"))
def jsn10(spark: SparkSession, d: str) -> DataFrame:
    own = F.concat(F.lit("Part "), F.char(68 + F.col("p_partkey") % 20))
    return asked(spark, d, said=FORMULAS).withColumn("said", F.replace("said", F.lit("Part A"), own)).select("p_partkey", rules.formula_trees(F.col("said")).alias("tree"))


HTML = ["<title>A  b</title><nav>menu</nav><h1>One</h1><p>x &amp; y<br>z</p><script>no()</script>", "<p>open <b>bold", "", None]


@query("src07_html_texts", "SELECT s.p_partkey, replace(title, 'A b', p_name) AS title, replace(replace(text, 'x & y', p_name || ' & ' || p_brand), 'bold', p_name) AS text FROM (" + stated("title VARCHAR, text VARCHAR", [("A b", "# One~x & y~z"), ("", "open bold"), ("", ""), ("", "")]) + ") s JOIN part USING (p_partkey)")
def src07(spark: SparkSession, d: str) -> DataFrame:
    """Pages about parts, with their names in titles, marks and entities."""
    html, name = F.col("html"), F.col("p_name")
    for place, own in (("A  b", F.replace(name, F.lit(" "), F.lit("  \n"))), ("x &amp; y", F.concat(name, F.lit(" &amp; "), "p_brand")), ("bold", name)):
        html = F.replace(html, F.lit(place), own)
    df = asked(spark, d, html=HTML).join(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey").withColumn("html", html)
    df = files.page_texts(df.select("p_partkey", "html"))
    return df.select("p_partkey", F.col("_title").alias("title"), F.replace("_text", F.lit("\n"), F.lit("~")).alias("text"))


@query("src06_guide_files", "SELECT 'ABCD' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') || '_2025.md' AS name, p_name AS title, CAST(p_partkey AS VARCHAR) AS part, 'about ' || p_name AS body FROM part WHERE p_partkey % 50 = 0 AND p_partkey % 3 <> 0")
def src06(spark: SparkSession, d: str) -> DataFrame:
    """Guides as files in a folder, read by their names' pattern; files of other names beside them are no guides. Every fiftieth part has a file; names come again
    after ten thousand parts, so that each ten thousand have a folder."""
    part = table(spark, d, "part").filter("p_partkey % 50 = 0")
    name = F.concat(F.floor(F.col("p_partkey") / 10000).cast("string"), F.lit("/"), F.when(F.col("p_partkey") % 3 != 0, "ABCD").otherwise("AB"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.lit("_2025"))
    text = F.concat(F.lit("---\ntitle: "), "p_name", F.lit("\npart: "), F.col("p_partkey").cast("string"), F.lit("\n---\nabout "), "p_name")
    at = scratch(spark, "guides")
    files.write_named(part.select(name.alias("name"), text.alias("text")), at, "md")
    return files.guides(spark, at, folders=True).select("name", F.col("front")["title"].alias("title"), F.col("front")["part"].alias("part"), F.rtrim("body", F.lit("\n")).alias("body"))


FRONT = """course_code: {code}
year: 2025
checked: yes
tags: [easy, 'two words']
claims:
  prereq: "OBOE2200: or more"
  assessment:
    - name: Essay
      weight: 40
    - name: Exam
      weight: 59.5
      hurdle: true
"""


@query("src05_front_matter", "SELECT p_partkey, 2025 AS year, true AS checked, 'two words' AS tag, 'OBOE2200: or more' AS prereq, CAST(2 AS BIGINT) AS n, 59.5::DOUBLE AS weight, true AS hurdle FROM part")
def src05_front(spark: SparkSession, d: str) -> DataFrame:
    front = F.replace(F.lit(FRONT), F.lit("{code}"), F.concat(F.lit("PART"), F.col("p_partkey").cast("string")))
    v = files.front_variant(front)
    got = lambda path, kind: F.variant_get(F.col("v"), path, kind)
    df = table(spark, d, "part").select("p_partkey", v.alias("v"))
    items = got("$.claims.assessment", "array<struct<name string, weight double, hurdle boolean>>")
    return df.select(
        "p_partkey", got("$.year", "int").alias("year"), got("$.checked", "boolean").alias("checked"), got("$.tags[1]", "string").alias("tag"), got("$.claims.prereq", "string").alias("prereq"),
        F.size(items).cast("long").alias("n"), items[1]["weight"].alias("weight"), items[1]["hurdle"].alias("hurdle"),
    )
