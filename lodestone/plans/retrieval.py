"""Queries of retrieval: filters, top-k, vector, keyword and fused search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens, url_parts
from lodestone.functions.vectors import cosine
from lodestone.operators import filters, graph_index, retrieval, text_index
from lodestone.registry import query, table
from lodestone.sources.files import identity, scratch
from lodestone.sources.published import Published

#: A query by keywords, and the words of its two stems, as the SQL finds them.
KEYWORDS = "erly thinging"
HIT = "regexp_full_match(x, 'er((ly)?|ly(ed|ing)(ly)?)|thing(es|ed|ing|ly|edly|ingly|ly(ed|ing)(ly)?)?')"
#: A phrase over a stop word, and its words as the SQL finds them at places i to i + 2.
PHRASE = '"attion to thanedble"'
PHRASE_HIT = "regexp_full_match(w[i], 'attion(er|es|ed|ing|ly|edly|ingly|ering|lyed)?') AND w[i + 2] = 'thanedble'"
QUERY_EVERY = 50


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """documents as offerings: id, code (the source), text, lang, units (n_chars) and a vector where there is one."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("code"), "text", "lang", F.col("n_chars").alias("units"))
    return docs.join(vectors, "id", "left")


_INDEXES: dict[tuple, tuple[Published, Published]] = {}


def indexed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The published index of documents' texts, and the other columns of the corpus, so that a search never reads documents. Both are made once for each state of the
    tables' files in an application."""
    key = (spark.sparkContext.applicationId, identity(spark, f"{d}/documents.parquet"), identity(spark, f"{d}/embeddings.parquet"))
    if key not in _INDEXES:
        texts = text_index.build(spark, scratch(spark, "text-index"), table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
        rest = Published(spark, scratch(spark, "corpus"))
        rest.load(0, lambda _: corpus(spark, d).drop("text"))
        _INDEXES[key] = texts, rest
    texts, rest = _INDEXES[key]
    return texts.read(), rest.read()


def fused(spark: SparkSession, d: str, floor: float, where: F.Column | None = None) -> DataFrame:
    texts, rows = indexed(spark, d)
    found = retrieval.fused_search(rows, vector(spark, d, 0), KEYWORDS, 8, floor, where, lambda of, k: text_index.search(texts, KEYWORDS, k, of if where is not None else None))
    return found.select("id", "code", r6("sim"), r6("score"))


def vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    return table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]


def near(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def r6(name: str) -> F.Column:
    return F.round(name, 6).alias(name)


COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"
Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = {i})"


def fused_sql(where: str, k: int, floor: float) -> str:
    return f"""
    WITH c AS (SELECT doc_id AS id, source AS code, text, {COS.format(a="embedding", b=Q0.format(i=0))} AS sim FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE {where}),
    t AS (SELECT id, code, sim, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: {HIT}) AS hits FROM c),
    v AS (SELECT id, code, sim, row_number() OVER (ORDER BY sim DESC, id) AS v_rank FROM c WHERE sim IS NOT NULL QUALIFY v_rank <= {3 * k}),
    w AS (SELECT id, code, sim, row_number() OVER (ORDER BY len(hits) DESC, id) AS k_rank FROM t WHERE len(list_distinct(list_transform(hits, lambda x: x[1]))) = 2 QUALIFY k_rank <= {3 * k}),
    f AS (SELECT coalesce(v.id, w.id) AS id, coalesce(v.code, w.code) AS code, coalesce(v.sim, w.sim) AS sim, coalesce(1.0::DOUBLE / (60 + v_rank), 0) + coalesce(1.0::DOUBLE / (60 + k_rank), 0) AS score, v_rank, k_rank FROM v FULL JOIN w ON v.id = w.id),
    g AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY score DESC, v_rank NULLS LAST, k_rank NULLS LAST) AS n FROM f WHERE sim >= {floor})
    SELECT id, code, round(sim, 6) AS sim, round(score, 6) AS score FROM g WHERE n = 1 ORDER BY g.score DESC, v_rank NULLS LAST, k_rank NULLS LAST LIMIT {k}"""


@query("rrf01_fused_search", fused_sql("lang IN ('en', 'de')", 8, -1.0))
def rrf01(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d, -1.0, F.col("lang").isin("en", "de"))


@query("rrf02_semantic_search", fused_sql("TRUE", 8, 0.05))
def rrf02(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d, 0.05)


@query("rrf03_hybrid_filtered", fused_sql("lang = 'en' AND n_chars > 200", 8, -1.0))
def rrf03(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d, -1.0, (F.col("lang") == "en") & (F.col("units") > 200))


@query("vec01_cosine", f"SELECT vec_id, round({COS.format(a='embedding', b=Q0.format(i=1))}, 6) AS sim FROM embeddings")
def vec01(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.functions.vectors import literal

    return table(spark, d, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), literal(vector(spark, d, 1))), 6).alias("sim"))


@query("vec02_knn_topk", f"SELECT vec_id AS id, round({COS.format(a='embedding', b=Q0.format(i=0))}, 6) AS sim FROM embeddings ORDER BY {COS.format(a='embedding', b=Q0.format(i=0))} DESC, vec_id LIMIT 24")
def vec02(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.knn(near(spark, d), vector(spark, d, 0), 24).select("id", r6("sim"))


JOIN_SQL = f"SELECT q.vec_id AS query_id, c.vec_id AS id, q.label AS q_label, c.label AS c_label, {COS.format(a='q.embedding', b='c.embedding')} AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS.format(a='q.embedding', b='c.embedding')} DESC, c.vec_id) AS rank FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0 QUALIFY rank <= 5"


@query("joi11_knn_join", f"SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS sim FROM ({JOIN_SQL})")
def joi11(spark: SparkSession, d: str) -> DataFrame:
    rows = near(spark, d)
    return retrieval.knn_join(rows.filter(F.col("id") % QUERY_EVERY == 0), rows, 5).select("query_id", "id", "rank", r6("sim"))


@query("evl05_hit_at_k", f"SELECT CAST(avg(h1) AS DOUBLE) AS hit_at_1, CAST(avg(h3) AS DOUBLE) AS hit_at_3 FROM (SELECT query_id, max(CASE WHEN rank <= 1 AND q_label = c_label THEN 1.0 ELSE 0.0 END) AS h1, max(CASE WHEN rank <= 3 AND q_label = c_label THEN 1.0 ELSE 0.0 END) AS h3 FROM ({JOIN_SQL}) GROUP BY query_id)")
def evl05(spark: SparkSession, d: str) -> DataFrame:
    rows = near(spark, d)
    labels = rows.select("id", "label")
    found = retrieval.knn_join(rows.filter(F.col("id") % QUERY_EVERY == 0), rows, 5).join(labels, "id")
    found = found.join((labels.filter(F.col("id") % QUERY_EVERY == 0).select(F.col("id").alias("query_id"), F.col("label").alias("wanted"))), "query_id")
    hit = lambda k: F.max(F.when((F.col("rank") <= k) & (F.col("label") == F.col("wanted")), 1.0).otherwise(0.0))
    return found.groupBy("query_id").agg(hit(1).alias("h1"), hit(3).alias("h3")).agg(F.avg("h1").alias("hit_at_1"), F.avg("h3").alias("hit_at_3"))


@query("kb01_threshold_topk", f"SELECT id, code, round(sim, 6) AS sim FROM (SELECT * FROM (SELECT vec_id AS id, source AS code, {COS.format(a='embedding', b=Q0.format(i=0))} AS sim FROM embeddings JOIN documents ON doc_id = vec_id) ORDER BY sim DESC, id LIMIT 20) WHERE sim >= 0.1 ORDER BY sim DESC, id LIMIT 5")
def kb01(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top(retrieval.knn(corpus(spark, d), vector(spark, d, 0), 20, 0.1), [F.desc("sim"), F.asc("id")], 5).select("id", "code", r6("sim"))


@query("kb02_two_query_max", f"SELECT vec_id AS id, round(greatest({COS.format(a='embedding', b=Q0.format(i=0))}, {COS.format(a='embedding', b=Q0.format(i=7))}), 6) AS sim FROM embeddings ORDER BY greatest({COS.format(a='embedding', b=Q0.format(i=0))}, {COS.format(a='embedding', b=Q0.format(i=7))}) DESC, vec_id LIMIT 20")
def kb02(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.knn(near(spark, d), vector(spark, d, 0), 20, other=vector(spark, d, 7)).select("id", r6("sim"))


@query("kb03_scoped_knn", f"SELECT id, round(sim, 6) AS sim FROM (SELECT vec_id AS id, {COS.format(a='embedding', b=Q0.format(i=0))} AS sim FROM embeddings JOIN documents ON doc_id = vec_id WHERE source = 'src1' ORDER BY sim DESC, id LIMIT 8) WHERE sim >= 0.0 ORDER BY sim DESC, id LIMIT 4")
def kb03(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top(retrieval.knn(corpus(spark, d).filter("code = 'src1'"), vector(spark, d, 0), 8, 0.0), [F.desc("sim"), F.asc("id")], 4).select("id", r6("sim"))


@query("kb04_rerank", f"SELECT id, round(sim, 6) AS sim, units FROM (SELECT vec_id AS id, n_chars AS units, {COS.format(a='embedding', b=Q0.format(i=0))} AS sim FROM embeddings JOIN documents ON doc_id = vec_id ORDER BY sim DESC, id LIMIT 20) ORDER BY units DESC, id LIMIT 5")
def kb04(spark: SparkSession, d: str) -> DataFrame:
    pool = retrieval.knn(corpus(spark, d), vector(spark, d, 0), 20)
    return retrieval.rerank(pool, F.col("units"), [F.asc("id")]).limit(5).select("id", r6("sim"), "units")


@query("kb05_latest_detail", "SELECT source AS code, arg_max(doc_id, doc_id) AS id, arg_max(n_chars, doc_id) AS units, array_to_string(list_sort(list_distinct(list(lang))), '|') AS langs FROM documents GROUP BY source")
def kb05(spark: SparkSession, d: str) -> DataFrame:
    latest = F.max_by(F.struct("doc_id", "n_chars"), "doc_id")
    df = table(spark, d, "documents").groupBy(F.col("source").alias("code")).agg(latest.alias("row"), F.array_join(F.array_sort(F.collect_set("lang")), "|").alias("langs"))
    return df.select("code", F.col("row.doc_id").alias("id"), F.col("row.n_chars").alias("units"), "langs")


@query("kb06_fallback_arbitration", f"""WITH s AS (SELECT q.vec_id AS query_id, max(CASE WHEN c.label < 5 THEN {COS.format(a='q.embedding', b='c.embedding')} END) AS own_top, max(CASE WHEN c.label >= 5 THEN {COS.format(a='q.embedding', b='c.embedding')} END) AS other_top FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0 GROUP BY q.vec_id)
    SELECT query_id, CASE WHEN own_top < 0.55 AND other_top > own_top THEN 'other' ELSE 'own' END AS route FROM s""")
def kb06(spark: SparkSession, d: str) -> DataFrame:
    rows = near(spark, d)
    queries = rows.filter(F.col("id") % QUERY_EVERY == 0)
    own = retrieval.knn_join(queries, rows.filter("label < 5"), 1).select("query_id", F.col("sim").alias("own_top"))
    other = retrieval.knn_join(queries, rows.filter("label >= 5"), 1).select("query_id", F.col("sim").alias("other_top"))
    return own.join(other, "query_id", "full").select("query_id", retrieval.arbitrated(F.col("own_top"), F.col("other_top"), 0.55, 0.62, F.lit(False)).alias("route"))


@query("fts01_term_match", f"SELECT doc_id AS id, CAST(len(hits) AS INTEGER) AS tf FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: {HIT}) AS hits FROM documents) WHERE len(list_distinct(list_transform(hits, lambda x: x[1]))) = 2 ORDER BY len(hits) DESC, doc_id LIMIT 20")
def fts01(spark: SparkSession, d: str) -> DataFrame:
    return text_index.search(indexed(spark, d)[0], KEYWORDS, 20).select("id", "tf")


@query("fts01_phrase_match", f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    h AS (SELECT doc_id, len(list_filter(range(1, len(w) - 1), lambda i: {PHRASE_HIT})) AS n, len(list_filter(w, lambda x: {HIT})) AS other FROM t)
    SELECT doc_id AS id, CAST(n AS INTEGER) AS tf, CAST(row_number() OVER (ORDER BY n DESC, doc_id) AS INTEGER) AS rank FROM h WHERE n > 0 AND other = 0 QUALIFY rank <= 40""")
def fts01_phrase(spark: SparkSession, d: str) -> DataFrame:
    return text_index.search(indexed(spark, d)[0], f"{PHRASE} -erly -thinging", 40)


@query("fts03_index_totals", "SELECT count(DISTINCT doc_id) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words, CAST(sum(len(w) * (len(w) - 1) / 2) AS BIGINT) AS places FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents) WHERE len(w) > 0")
def fts03(spark: SparkSession, d: str) -> DataFrame:
    """Every word of every text stands in the index, at its place: a new index, as it is written, against counts of the texts."""
    rows = text_index.build(spark, scratch(spark, "text-index"), table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).read()
    sums = F.aggregate(F.flatten("places"), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_words"), F.sum(sums).alias("places")).join(
        rows.select(F.explode("ids").alias("id")).agg(F.count_distinct("id").alias("n_docs"))
    )


@query("fts02_term_index", "SELECT term, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2) GROUP BY term")
def fts02(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.term_index(docs).groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n"))


@query("fil01_slots", "SELECT p_partkey, p_type, p_size FROM part WHERE p_size = 5 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') OR p_size = 7 AND p_brand NOT IN ('Brand#11')")
def fil01(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumnsRenamed({"p_size": "units", "p_brand": "course_type"})
    one = filters.where(part, {"units": 5, "course_type_only": ["Brand#11", "Brand#12", "Brand#13"], "level": None, "nonsense": 1})
    two = filters.where(part, {"units": 7, "course_type_exclude": ["Brand#11"]})
    return one.unionByName(two).select("p_partkey", "p_type", F.col("units").alias("p_size"))


@query("fil02_semester_flag", "SELECT l_partkey AS part, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def fil02(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("offered_s1", F.col("l_returnflag") == "A")
    return filters.where(rows, {"semester": "S1"}).groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"))


@query("fil03_code_level", "SELECT p_partkey FROM part WHERE regexp_extract(p_brand, '[0-9]') IN ('2', '3')")
def fil03(spark: SparkSession, d: str) -> DataFrame:
    return filters.where(table(spark, d, "part").withColumn("code", F.col("p_brand")), {"code_level": ["2", "3"]}).select("p_partkey")


@query("fil04_unit_list", "SELECT p_partkey FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_partkey IN (1, 2))")
def fil04(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("coordinating_unit", F.col("p_type"))
    units = [r[0] for r in part.filter("p_partkey IN (1, 2)").select("p_type").distinct().collect()]
    return filters.where(part, {}, units=[*units, ""]).select("p_partkey")


@query("fil05_title_exclude", "SELECT p_partkey FROM part WHERE coalesce(nullif(p_name, (SELECT p_name FROM part WHERE p_partkey = 3)), '') NOT LIKE '%red%' AND coalesce(lower(nullif(p_name, (SELECT p_name FROM part WHERE p_partkey = 3))), '') NOT LIKE '%widget%'")
def fil05(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    name = part.filter("p_partkey = 3").first()["p_name"]
    part = part.withColumn("title", F.nullif("p_name", F.lit(name)))
    return filters.where(part, {}, exclude_title=["red", "WIDGET"]).select("p_partkey")


@query("fil07_dedup_preferred", """WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_orderkey, l_linenumber) AS n, first_value(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS pos FROM lineitem)
    SELECT l_partkey, l_orderkey, l_linenumber, l_returnflag, pos AS position FROM x WHERE n = 1""")
def fil07(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag")
    found = filters.preferred_per_key(rows, "l_partkey", ["l_orderkey", "l_linenumber"], F.col("l_returnflag") == "R")
    return found.select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", F.col("_position.l_orderkey").alias("position"))


@query("fil08_both_conjunction", "SELECT l_partkey, 'A+R' AS semester, min(l_orderkey) AS first_order FROM lineitem GROUP BY l_partkey HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R')")
def fil08(spark: SparkSession, d: str) -> DataFrame:
    flag = lambda x: F.bool_or(F.col("l_returnflag") == x)
    df = table(spark, d, "lineitem").groupBy("l_partkey").agg(flag("A").alias("a"), flag("R").alias("r"), F.min("l_orderkey").alias("first_order"))
    return df.filter("a AND r").select("l_partkey", F.lit("A+R").alias("semester"), "first_order")


@query("fil09_projection_url", "SELECT p_partkey, p_name, 'https://catalogue.example/part/' || p_brand AS url FROM part")
def fil09(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_name", F.concat(F.lit("https://catalogue.example/part/"), "p_brand").alias("url"))


@query("fil11_unknown_count", "SELECT lang, count(DISTINCT source) FILTER (WHERE quality = 0) AS none_codes, count(DISTINCT source) FILTER (WHERE quality IS NULL) AS unknown_codes FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def fil11(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return df.groupBy("lang").agg(F.count_distinct(F.when(F.col("quality") == 0, F.col("source"))).alias("none_codes"), F.count_distinct(F.when(F.col("quality").isNull(), F.col("source"))).alias("unknown_codes"))


@query("fil12_search", "SELECT DISTINCT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%12%' OR lower(p_brand) LIKE '%12%' ORDER BY p_partkey LIMIT 50")
def fil12(spark: SparkSession, d: str) -> DataFrame:
    hit = F.contains(F.lower("p_name"), F.lit("12")) | F.contains(F.lower("p_brand"), F.lit("12"))
    return table(spark, d, "part").filter(hit).select("p_partkey", "p_name").distinct().orderBy("p_partkey").limit(50)


@query("fil13_scope_intersection", "SELECT p_partkey FROM part WHERE p_size > 10 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1)")
def fil13(spark: SparkSession, d: str) -> DataFrame:
    scope = table(spark, d, "lineitem").filter("l_suppkey = 1").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").filter("p_size > 10").join(scope, "p_partkey", "left_semi").select("p_partkey")


@query("fil14_stratified_round_robin", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n, min(doc_id) OVER (PARTITION BY lang) AS f FROM documents) WHERE n <= 4 ORDER BY n, f LIMIT 12")
def fil14(spark: SparkSession, d: str) -> DataFrame:
    return filters.round_robin(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 4, 12).select("doc_id", "lang")


@query("fil15_url_keep_reasons", """WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*/([^/?#]*)', 1) AS seg, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM pages)
    SELECT CASE WHEN n > 1 THEN 'duplicate' WHEN host NOT LIKE '%.com' THEN 'off_domain' WHEN seg IN ('es', 'de') THEN 'blacklist' ELSE 'kept' END AS reason, count(*) AS n FROM u GROUP BY 1""")
def fil15(spark: SparkSession, d: str) -> DataFrame:
    host, segment = url_parts(F.col("url"))
    n = F.row_number().over(Window.partitionBy("url").orderBy("page_id"))
    reason = F.when(F.col("n") > 1, "duplicate").when(~F.col("host").endswith(".com"), "off_domain").when(F.col("segment").isin("es", "de"), "blacklist").otherwise("kept")
    return table(spark, d, "pages").select(host.alias("host"), segment.alias("segment"), n.alias("n")).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("fil16_array_gate", "SELECT vec_id, len(embedding) AS n FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0")
def fil16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter(F.coalesce(F.size("embedding"), F.lit(0)) > 0).select("vec_id", F.size("embedding").cast("long").alias("n"))


@query("srt01_allow_listed_order", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM documents ORDER BY n, doc_id LIMIT 20")
def srt01(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top(table(spark, d, "documents").select("doc_id", F.coalesce(F.size(tokens(F.col("text"))), F.lit(999)).cast("long").alias("n")), [F.asc("n"), F.asc("doc_id")], 20)


@query("srt03_name_rank", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' ORDER BY lower(p_name) = 'ring' DESC, lower(p_name) LIKE 'ring%' DESC, length(p_name), p_name, p_partkey LIMIT 15")
def srt03(spark: SparkSession, d: str) -> DataFrame:
    name = F.lower("p_name")
    df = table(spark, d, "part").filter(F.contains(name, F.lit("ring"))).select("p_partkey", "p_name")
    return retrieval.top(df, [F.desc(name == "ring"), F.desc(name.startswith("ring")), F.length("p_name").asc(), F.asc("p_name"), F.asc("p_partkey")], 15)


@query("srt04_latest_nulls_last", "SELECT o_custkey, max(o_orderdate)::VARCHAR AS latest, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def srt04(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    found = filters.first_per_key(orders.select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", [F.desc_nulls_last("o_orderdate"), F.asc("o_orderkey")])
    return found.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("latest"), "o_orderkey")


@query("srt06_capped_list", "SELECT source, array_to_string(list_sort(list(doc_id))[1:8], ',') AS shown, greatest(count(*) - 8, 0) AS more FROM documents GROUP BY source")
def srt06(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    total = table(spark, d, "documents").groupBy("source").agg(F.greatest(F.count("*") - 8, F.lit(0)).alias("more"))
    shown = table(spark, d, "documents").select("source", "doc_id", n.alias("n")).filter("n <= 8").groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("shown"))
    return shown.join(total, "source").select("source", "shown", "more")


@query("srt07_every_nth", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE (n - 1) % 50 = 0")
def srt07(spark: SparkSession, d: str) -> DataFrame:
    return filters.every_nth(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 50)


WORDS = ["running shoes", "she runs", "a runner ran", "connection connected", "connecting", "disconnect"]


@query("fts03_stemmed_query", "SELECT p_partkey AS id, CAST(CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 1 END AS INTEGER) AS tf FROM part WHERE p_partkey % 6 IN (0, 1, 3, 4) AND NOT (p_partkey % 6 = 1 AND p_type = 'PROMO')")
def fts03(spark: SparkSession, d: str) -> DataFrame:
    """Alternatives, stop words, inflected forms and a word that must not stand, over all parts."""
    said = F.get(F.array(*map(F.lit, WORDS)), (F.col("p_partkey") % len(WORDS)).cast("int"))
    text = F.when((F.col("p_partkey") % 6 == 1) & (F.col("p_type") == "PROMO"), F.concat(said, F.lit(" promos"))).otherwise(said)
    return retrieval.term_hits(table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text")), "the run OR connections -promo")


@query("str24_contains", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') AND NOT contains(lower(p_name), '%')")
def str24(spark: SparkSession, d: str) -> DataFrame:
    """A user's text is looked for as it is: a percent sign or an underscore is no wild card."""
    name = F.lower("p_name")
    return table(spark, d, "part").filter(F.contains(name, F.lit("ring")) & ~F.contains(name, F.lit("%"))).select("p_partkey")


@query("fil06_description", """SELECT p_partkey, concat_ws(' AND ', CASE WHEN p_size % 2 = 0 THEN 'has_exam = ' || CASE WHEN p_size % 4 = 0 THEN 'true' ELSE 'false' END END, CASE WHEN p_size % 3 <> 0 THEN 'level = ' || q || p_type || q END,
    'units = ' || p_size, CASE WHEN p_size % 5 = 0 THEN 'course_type NOT IN (' || q || p_brand || q || ', ' || q || p_name || q || ')' END) AS described FROM (SELECT *, chr(39) AS q FROM part)""")
def fil06(spark: SparkSession, d: str) -> DataFrame:
    """Slots of each part in words."""
    size = F.col("p_size")
    slots = {
        "has_exam": F.when(size % 2 == 0, size % 4 == 0), "level": F.when(size % 3 != 0, F.col("p_type")), "units": size,
        "course_type_exclude": F.when(size % 5 == 0, F.array("p_brand", "p_name")),
    }
    return table(spark, d, "part").select("p_partkey", filters.described(slots).alias("described"))


PHRASES = ["units = 2", "units = 2; drop table x", "title = 'a'", "  ", "level = 'x' -- y", "updated = true"]


@query("fil10_where_guard", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'banned' WHEN 2 THEN 'text column' WHEN 3 THEN 'empty' WHEN 4 THEN 'banned' ELSE 'ok' END AS verdict FROM part")
def fil10(spark: SparkSession, d: str) -> DataFrame:
    said = F.get(F.array(*map(F.lit, PHRASES)), (F.col("p_partkey") % len(PHRASES)).cast("int"))
    return table(spark, d, "part").select("p_partkey", filters.condition_verdict(said).alias("verdict"))


@query("fil17_column_probe", "SELECT 'p_size' AS name, true AS there, count(p_size) AS n FROM part UNION ALL SELECT 'nonsense', false, 0")
def fil17(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return filters.probed(part, "p_size").unionByName(filters.probed(part, "nonsense"))


@query("vec03_hyperplane_index", "SELECT count(*) AS n_indexed, true AS recall_reached FROM embeddings")
def vec03(spark: SparkSession, d: str) -> DataFrame:
    """An index of signed buckets over all vectors, and whether its search finds nine of ten of the exact nearest."""
    rows = near(spark, d)
    index = retrieval.hyperplane_index(rows)
    queries = rows.filter(F.col("id") % QUERY_EVERY == 0)
    exact = retrieval.knn_join(queries, rows, 5).select("query_id", "id")
    found = retrieval.index_search(index, queries, 5).select("query_id", "id")
    hit = exact.join(found, ["query_id", "id"], "left_semi").agg(F.count("*").alias("hit")).join(exact.agg(F.count("*").alias("of")))
    return hit.select((F.col("hit") >= 0.9 * F.col("of")).alias("recall_reached")).join(index.agg(F.count_distinct("id").alias("n_indexed"))).select("n_indexed", "recall_reached")


@query("vec03_graph_index", "SELECT count(*) AS n_indexed, true AS recall_reached, true AS fewer_than_all FROM embeddings")
def vec03_graph(spark: SparkSession, d: str) -> DataFrame:
    """A graph over all vectors; whether walks find nine of ten of the exact nearest, and compare fewer pairs than there are."""
    rows = near(spark, d)
    vectors, edges = graph_index.build(rows)
    asked = F.col("id") % QUERY_EVERY == 0
    found, compared = graph_index.search(vectors, edges, vectors.filter(asked), 5)
    exact = retrieval.knn_join(rows.filter(asked), rows, 5).select("query_id", "id")
    hit = exact.join(found, ["query_id", "id"], "left_semi").agg(F.count("*").alias("hit")).join(exact.agg(F.count("*").alias("of")))
    count = vectors.agg(F.count("*").alias("n_indexed"), F.count_if(asked).alias("asked")).join(compared.agg(F.count("*").alias("compared")))
    return count.join(hit).select("n_indexed", (F.col("hit") >= 0.9 * F.col("of")).alias("recall_reached"), (F.col("compared") < F.col("asked") * (F.col("n_indexed") - 1)).alias("fewer_than_all"))


@query("kb06_filter_fallback", "SELECT vec_id, CASE WHEN label < 5 AND vec_id % 2 = 0 AND label / 4.0 >= 0.62 OR label >= 5 AND label / 10.0 > coalesce(CASE WHEN vec_id % 2 = 1 THEN 0.5 END, -1) THEN 'other' ELSE 'own' END AS route FROM embeddings")
def kb06_filter(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as questions: the lower labels were filters, of which every other found nothing; the others were searches with weak results."""
    is_filter, label = F.col("label") < 5, F.col("label").cast("double")
    own = F.when(F.col("vec_id") % 2 == 1, 0.5)
    return table(spark, d, "embeddings").select("vec_id", retrieval.arbitrated(own, F.when(is_filter, label / 4.0).otherwise(label / 10.0), 0.55, 0.62, is_filter).alias("route"))
