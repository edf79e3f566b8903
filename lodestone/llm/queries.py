"""The queries of this subpackage, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import block_search, fill_in_middle, license_scan, mixing, pieces, quality_classifier, quality_rules, repeats, simhash, tiered_search, url_filter, vector_search, warc
from lodestone.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns, n_passages and n_passage_bytes: passages of over 50 words that stand elsewhere too, whatever their bytes."""
    df = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_first=False, report=51, keep=["doc_id"])
    total = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return df.select(
        "doc_id",
        F.col("_bytes").alias("n_bytes"),
        total("_spans").alias("n_removed"),
        F.size("_spans").cast("long").alias("n_spans"),
        F.sha2("_rest", 256).alias("kept_sha256"),
        F.size("_passages").cast("long").alias("n_passages"),
        total("_passages").alias("n_passage_bytes"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = warc.archive(table(spark, sf_dir, "pages"))
    return df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mixing.mix(table(spark, sf_dir, "documents"))
    return df.select("doc_id", F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_times")).alias("taken"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pieces.encode(table(spark, sf_dir, "documents"))
    return df.select("doc_id", F.size("_ids").cast("long").alias("n_pieces"), F.col("_ids").alias("ids"), F.col("_decoded_sha256").alias("decoded_sha256"), F.col("_exact").alias("round_trip"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op11_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_search.top_products(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    sha = lambda c: F.sha2(F.col(c), 256)
    return df.select(
        "doc_id",
        F.col("_n").alias("n"),
        F.col("_form").alias("form"),
        F.col("_prefix_units").alias("prefix_chars"),
        F.col("_middle_units").alias("middle_chars"),
        sha("_output").alias("output_sha256"),
        sha("_restored").alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_url_filter": op5_url_filter,
    "op6_quality_rules": op6_quality_rules,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_nearest": op8_nearest,
    "op9_simhash": op9_simhash,
    "op10_license_scan": op10_license_scan,
    "op11_tiered_search": op11_tiered_search,
    "op12_block_search": op12_block_search,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: A digest in base 32: each five of its hexadecimal digits are four characters.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(s, {5 * i + 1}, 5))::BIGINT >> {shift}) & 31 AS INTEGER) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))

ORACLE_SQL: dict[str, str] = {
    "op2_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS s, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept FROM pages)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> kept THEN kept END AS refers_to FROM p""",
    "op11_tiered_search": r"""WITH w AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        c AS (SELECT count(*) AS n_docs, sum(len(ts)) AS n_terms FROM w WHERE len(ts) > 0),
        p AS (SELECT d, doc_id, t, n, count(*) AS tf FROM (SELECT d, doc_id, len(ts) AS n, unnest(ts) AS t FROM w) GROUP BY ALL),
        i AS (SELECT item_id, k, t, count(*) AS times FROM (SELECT item_id, row_number() OVER () AS k, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
        f AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t, n_docs),
        s AS (SELECT i.item_id, i.k, p.d, p.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM i JOIN p USING (t) JOIN f USING (t), c GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST, d) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "op12_block_search": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20""",
    "op13_fill_in_middle": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
        h AS (SELECT *, {", ".join(f"('0x' || substr(s, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))} FROM d),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
}
