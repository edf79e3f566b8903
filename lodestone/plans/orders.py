"""Queries of joins by order, windows over whole tables, sketches, views and published loads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import ingest, ordered, ranges, sketches, views
from lodestone.plans.loads import chunked
from lodestone.plans.relations import links
from lodestone.registry import query, table
from lodestone.sources.files import scratch
from lodestone.sources.published import Published


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


@query("joi12_asof", """WITH o AS (SELECT o_custkey, o_orderdate + INTERVAL 25 YEAR AS t, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2),
    e AS (SELECT event_id, user_id % 40 AS k, ts FROM events)
    SELECT event_id, o_orderkey FROM e ASOF LEFT JOIN o ON k = o_custkey AND ts >= t""")
def joi12_asof(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the latest order before it of its customer (orders 25 years later, so that they meet the events' time)."""
    events = table(spark, d, "events").select("event_id", (F.col("user_id") % 40).alias("k"), micros("ts").alias("ts"))
    orders = table(spark, d, "orders").select("o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 25 YEARS")).alias("at"), "o_orderkey")
    return ranges.asof_join(events, orders, ("ts", "at"), ("k", "o_custkey"), ["o_orderkey"]).select("event_id", "o_orderkey")


#: Lines as intervals: from shipment for as many days as the quantity says, the last ones years.
LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate) AS lo, epoch_us(l_shipdate) + CAST(CASE WHEN l_quantity >= 50 THEN 900 ELSE l_quantity END AS BIGINT) * 86400000000 AS hi FROM lineitem"


def lines(spark: SparkSession, d: str) -> DataFrame:
    days = F.when(F.col("l_quantity") >= 50, 900).otherwise(F.col("l_quantity")).cast("long")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", micros("l_shipdate").alias("lo"), (micros("l_shipdate") + days * 86_400_000_000).alias("hi")
    )


@query("joi12_interval", f"SELECT o_orderkey, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM orders JOIN ({LINES}) ON o_custkey = l_suppkey AND epoch_us(o_orderdate) >= lo AND epoch_us(o_orderdate) < hi GROUP BY 1")
def joi12_interval(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose date lies in the interval of a line of a supplier of their customer's number."""
    points = table(spark, d, "orders").select("o_orderkey", "o_custkey", micros("o_orderdate").alias("at"))
    found = ranges.interval_join(points, "at", lines(spark, d), "lo", "hi", [("o_custkey", "l_suppkey")])
    return found.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


@query("joi12_overlap", f"""WITH l AS ({LINES}), o AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS a, epoch_us(o_orderdate) + (o_orderkey % 30) * 86400000000 AS b FROM orders)
    SELECT o_orderkey, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM o JOIN l ON o_custkey = l_suppkey AND a < b AND lo < hi AND a < hi AND lo < b GROUP BY 1""")
def joi12_overlap(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select("o_orderkey", "o_custkey", micros("o_orderdate").alias("a"), (micros("o_orderdate") + F.col("o_orderkey") % 30 * 86_400_000_000).alias("b"))
    found = ranges.overlap_join(own, lines(spark, d), ("a", "lo"), ("b", "hi"), [("o_custkey", "l_suppkey")])
    return found.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


_OVER = "(ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query("win06_total_order", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER {_OVER} AS number, CAST(ntile(7) OVER {_OVER} AS INTEGER) AS tile, sum(l_quantity) OVER {_OVER} AS running,
    lag(l_quantity) OVER {_OVER} AS lag, lead(l_quantity) OVER {_OVER} AS lead FROM lineitem""")
def win06(spark: SparkSession, d: str) -> DataFrame:
    """All lines in one order, by price."""
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    df = ordered.ordered(df, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")], ["l_quantity"], ["l_quantity"], 7)
    names = {"_number": "number", "_tile": "tile", "_sum_l_quantity": "running", "_lag_l_quantity": "lag", "_lead_l_quantity": "lead"}
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.col(k).alias(v) for k, v in names.items()])


@query("agg20_sketches", """SELECT l_returnflag, l_linestatus, CAST(2 - GROUPING(l_returnflag) - GROUPING(l_linestatus) AS INTEGER) AS level, count(*) AS n, true AS distinct_within, true AS quantiles_within
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def agg20(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of two increments, merged, then rolled up; at each level what they estimate against the rows."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_extendedprice")
    by, at = ["l_returnflag", "l_linestatus"], [0.1, 0.5, 0.9]
    parts = [sketches.kept(rows.filter(F.col("l_orderkey") % 2 == k), by, "l_orderkey", "l_extendedprice") for k in (0, 1)]
    found = sketches.estimates(sketches.rolled_up(sketches.merged(parts[0].unionByName(parts[1]), by), by), at)
    exact = rows.rollup(*by).agg(F.count_distinct("l_orderkey").alias("_d"), (F.lit(2) - F.grouping("l_returnflag") - F.grouping("l_linestatus")).cast("int").alias("_level"))
    same = (F.col("level") == F.col("_level")) & F.col("l_returnflag").eqNullSafe(F.col("_a")) & F.col("l_linestatus").eqNullSafe(F.col("_b"))
    found = found.join(exact.select(F.col("l_returnflag").alias("_a"), F.col("l_linestatus").alias("_b"), "_d", "_level"), same)
    # The rank of an estimated quantile among the rows: how many of the group lie under it, and at it.
    match = lambda c, x, k: (F.col("level") < k) | (F.col(c) == F.col(x))
    lines = rows.select(F.col("l_returnflag").alias("_f"), F.col("l_linestatus").alias("_s"), F.col("l_extendedprice").cast("double").alias("_p"))
    ranks = lines.join(F.broadcast(found.select("l_returnflag", "l_linestatus", "level", "q")), match("l_returnflag", "_f", 1) & match("l_linestatus", "_s", 2))  # a row a group
    ranks = ranks.groupBy("level", F.col("l_returnflag").alias("_a"), F.col("l_linestatus").alias("_b")).agg(
        F.count("*").alias("_all"), *[F.count_if(F.col("_p") < F.get("q", F.lit(i))).alias(f"_u{i}") for i in range(3)], *[F.count_if(F.col("_p") <= F.get("q", F.lit(i))).alias(f"_o{i}") for i in range(3)]
    )
    ok = [(F.col(f"_u{i}") <= (x + sketches.RANK_ERROR) * F.col("_all") + 1) & (F.col(f"_o{i}") >= (x - sketches.RANK_ERROR) * F.col("_all") - 1) for i, x in enumerate(at)]
    ranks = ranks.select(F.col("level").alias("_l2"), F.col("_a").alias("_a2"), F.col("_b").alias("_b2"), (ok[0] & ok[1] & ok[2]).alias("quantiles_within"))
    found = found.join(ranks, (F.col("level") == F.col("_l2")) & F.col("l_returnflag").eqNullSafe(F.col("_a2")) & F.col("l_linestatus").eqNullSafe(F.col("_b2")))
    within = F.abs(F.col("n_distinct") - F.col("_d")) <= F.ceil(sketches.DISTINCT_ERROR * F.col("_d"))
    return found.select("l_returnflag", "l_linestatus", "level", "n", within.alias("distinct_within"), "quantiles_within")


def batches(df: DataFrame, key: str, n: int = 3) -> list[DataFrame]:
    """Signed rows of df in n batches: each brings its share of the keys, and rows that the next one takes back (every fifth key); in the end all of df stands but the last share's."""
    part = F.pmod(F.xxhash64(key), F.lit(n))
    out = []
    for k in range(n):
        new = df.filter(part == k).withColumn(views.SIGN, F.lit(1).cast("long"))
        wrong = df.filter((part == (k + 1) % n) & (F.col(key) % 5 == 0)).withColumn(views.SIGN, F.lit(1).cast("long"))
        back = df.filter((part == k) & (F.col(key) % 5 == 0)).withColumn(views.SIGN, F.lit(-1).cast("long"))
        out.append(new.unionByName(wrong).unionByName(back) if k else new.unionByName(wrong))
    return [*out, df.filter((part == 0) & (F.col(key) % 5 == 0)).withColumn(views.SIGN, F.lit(-1).cast("long"))]


def applied(view: views.View, parts: list[DataFrame]) -> DataFrame:
    for k, rows in enumerate(parts):
        view.apply(k, rows)
        view.apply(k, rows)  # a batch that comes again
    return view.read()


@query("stm06_view", "SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def stm06_view(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums by customer, kept up to date by signed batches, of which each comes twice."""
    view = views.View(spark, scratch(spark, "view"), ["o_custkey"], lambda rows: views.counted(rows, ["o_custkey"], ["keys"]))
    return applied(view, batches(table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("keys")), "o_orderkey")).select("o_custkey", "n", "keys")


@query("snk09_index_view", "SELECT term, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2) GROUP BY term")
def snk09_index(spark: SparkSession, d: str) -> DataFrame:
    """The term index, kept up to date by signed batches of documents."""
    view = views.View(spark, scratch(spark, "view"), ["term", "id"], views.posted)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return applied(view, batches(docs, "id")).groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"))


def published(spark: SparkSession, base: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The state after a load of base, one of a step, one that dies between its data and the pointer, and the step's own again."""
    at = Published(spark, scratch(spark, "published"))
    at.load(0, lambda _: base)
    at.load(1, step)

    class Dies(Published):
        def _point(self, batch: int, folder: str) -> None:
            raise InterruptedError

    try:
        Dies(spark, at.root).load(2, lambda state: state.limit(0))
    except InterruptedError:
        pass
    at.load(1, lambda state: state.limit(0))  # no more than a rerun: it does nothing
    return at.read()


def _sql(name: str) -> str:
    from lodestone.registry import ORACLE_SQL

    return ORACLE_SQL[name]


@query("snk01_published", _sql("snk01_upsert"))
def snk01_published(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") + 100).alias("p_partkey"), F.col("l_linenumber").alias("p_size"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return published(spark, table(spark, d, "part").select("p_partkey", "p_name", "p_size"), lambda base: ingest.upsert(base, rows, "p_partkey", "o"))


@query("snk02_published", _sql("snk02_partial_upsert"))
def snk02_published(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("c_acctbal")).withColumn("at", F.lit(1))
    return published(spark, table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), lambda base: ingest.upsert(base, new, "c_custkey", "at"))


@query("snk03_published", _sql("snk03_replace_children"))
def snk03_published(spark: SparkSession, d: str) -> DataFrame:
    base = links(spark, d).select("program", "course").distinct()
    return published(spark, base, lambda now: ingest.replace_children(now, base.filter("program < 3").withColumn("course", F.col("course") + 1), "program"))


@query("snk04_published", _sql("snk04_vector_upsert"))
def snk04_published(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "labels").select("doc_id", F.lit("old").alias("text"), F.lit(None).cast("int").alias("label"))
    return published(spark, base, lambda now: chunked(spark, d, now)[0])


@query("snk05_published", _sql("snk05_replace_guides"))
def snk05_published(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").distinct()
    rows = lines.select(F.col("l_suppkey").alias("code"), F.year("l_shipdate").alias("year"), F.lit("old").alias("id"), at.alias("at"), F.struct(at, "l_partkey").alias("o"))
    return published(spark, rows.drop("o"), lambda now: ingest.replace_groups(now, rows.filter("code % 2 = 0").drop("id"), ["code", "year"], "o", "id"))
