"""Vector, keyword and fused retrieval. Searches are exact scans: one pass, and a top-k that leaves each task as k rows; text_index has keyword search through an index.

Keyword search matches English stems. Its rank is how often the query's stems stand, which is deterministic and not a database's own rank.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.stem import stem, stems
from lodestone.functions.text import tokens
from lodestone.functions.vectors import cosine, literal

RRF_K = 60
#: English words that keyword search passes over.
STOPPED = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above "
    "below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very "
    "s t can will just don should now".split()
)
#: Rows of a block of queries and of the corpus.
QUERY_BLOCK, CORPUS_BLOCK = 1024, 8192


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Ranks from 1 of a few rows, such as a top-k: they meet in one task."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def knn(df: DataFrame, vector: list[float], k: int, floor: float | None = None, id_column: str = "id", other: list[float] | None = None) -> DataFrame:
    """The k rows nearest to a vector (or to the nearer of two) by cosine, with sim; the floor holds after the limit."""
    sim = cosine(F.col("embedding"), literal(vector))
    if other is not None:
        sim = F.greatest(sim, cosine(F.col("embedding"), literal(other)))
    found = top(df.withColumn("sim", sim).filter("sim IS NOT NULL"), [F.desc("sim"), F.asc(id_column)], k)
    return found if floor is None else found.filter(F.col("sim") >= floor)


def knn_join(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """query_id, id, sim and rank of the k rows of corpus (id, embedding) nearest to each of queries (id, embedding), itself left out.

    Both sides are dealt to blocks of a bounded size; each pair of blocks is one group, from which k rows a query leave.
    """
    return _nearest_by_blocks(queries, corpus, k)


def _nearest_by_blocks(queries: DataFrame, corpus: DataFrame, k: int, cells: str | None = None) -> DataFrame:
    """cells: a column of both sides, an array of small numbers; only rows that have one of them in the same place are compared."""
    has = F.col("embedding").isNotNull()
    own = ["id", "embedding", *[cells] * (cells is not None)]
    queries, corpus = queries.filter(has).select(*own), corpus.filter(has).select(*own)
    n_q, n_c = queries.count(), corpus.count()
    q_blocks, c_blocks = max(1, -(-n_q // QUERY_BLOCK)), max(1, -(-n_c // CORPUS_BLOCK))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("q", dealt(q_blocks)).withColumn("c", each(c_blocks))
    right = corpus.withColumn("c", dealt(c_blocks)).withColumn("q", each(q_blocks))

    def unit(x: pd.Series) -> np.ndarray:
        x = np.stack(x).astype(np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def block(_: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "id": [], "sim": []}).astype({"query_id": "int64", "id": "int64", "sim": "float64"})
        c = c.sort_values("id", kind="stable")
        sims, own, asked = unit(q["embedding"]) @ unit(c["embedding"]).T, c["id"].to_numpy(), q["id"].to_numpy()
        if cells is not None:
            of_q, of_c = np.stack(q[cells]).T, np.stack(c[cells]).T.copy()
            meet = np.zeros(sims.shape, dtype=bool)
            for a, b in zip(of_q, of_c, strict=True):
                meet |= a[:, None] == b[None, :]
            sims[~meet] = -np.inf
        sims[asked[:, None] == own[None, :]] = -np.inf
        out = []
        for i, s in enumerate(sims):
            if len(s) > k:  # all that reach the k-th, so that ties go by id
                near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                near = near[np.lexsort((own[near], -s[near]))][:k]
            else:
                near = np.lexsort((own, -s))
            near = near[s[near] > -np.inf]
            out.append(pd.DataFrame({"query_id": asked[i], "id": own[near], "sim": s[near]}))
        return pd.concat(out)

    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInPandas(block, "query_id long, id long, sim double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hyperplane_index(df: DataFrame, tables: int = 24, planes: int = 4, seed: int = 7, size: int | None = None) -> DataFrame:
    """Every vector (id, embedding) once, with cells: for each of the tables the bucket of its sides of a few random planes.

    A bucket of a table holds about 1 of 2^planes vectors; more planes make finer buckets, more tables find more."""
    size = size or df.filter("embedding IS NOT NULL").select(F.size("embedding").alias("n")).first()["n"]
    normals = np.random.default_rng(seed).normal(size=(tables * planes, size)).round(6)
    weights = 1 << np.arange(planes)

    def sides(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="object")
        up = np.stack(vectors).astype(np.float64) @ normals.T >= 0
        return pd.Series(list((up.reshape(-1, tables, planes) @ weights).astype(np.int16)))

    return df.filter("embedding IS NOT NULL").select("id", "embedding", F.pandas_udf(sides, "array<smallint>")("embedding").alias("cells"))


def index_search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, sim and rank of the k nearest of what shares a bucket with each query; the exact search is knn_join.

    Most vectors share one with a query, so that pairs aren't listed: buckets are compared where vectors are, in pairs of blocks.
    """
    asked = index.join(queries.select(F.col("id").alias("_q")), F.col("id") == F.col("_q"), "left_semi")
    return _nearest_by_blocks(asked.select(*[F.col(c).alias(c) for c in ("id", "embedding", "cells")]), index, k, "cells")


def term_index(df: DataFrame) -> DataFrame:
    """The inverted index (term, id, tf) of id and text."""
    return df.select("id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("term", "id").agg(F.count("*").cast("int").alias("tf"))


def websearch(query: str) -> tuple[list[set[str]], set[str]]:
    """The stems of a query: groups of alternatives (or) that must all be met, and stems that must not stand (-word). Stop words go; a
    phrase in quotes counts as its words. A query without a word left raises."""
    groups, without, either = [], set(), False
    for mark, word in re.findall(r"(-?)([a-z0-9]+)", query.lower()):
        if word == "or" and not mark and groups:
            either = True
        elif word not in STOPPED:
            if mark:
                without.add(stem(word))
            elif either:
                groups[-1].add(stem(word))
            else:
                groups.append({stem(word)})
            either = False
    if not groups:
        raise ValueError("no words to search for")
    return groups, without


def term_hits(df: DataFrame, query: str) -> DataFrame:
    """id and tf, how often a word of the query's stems stands, of the rows of df (id, text) that meet the query.

    Only words that begin as a stem does (all but its last two letters, which suffixes may change) leave the texts; the distinct ones of
    these are stemmed, and the stems joined back.
    """
    groups, without = websearch(query)
    wanted = sorted(set().union(*groups) | without)
    heads = sorted({w[: max(1, len(w) - 2)] for w in wanted})
    begins = lambda x: reduce(lambda a, b: a | b, [x.startswith(h) for h in heads])
    terms = df.select("id", F.explode(F.filter(tokens(F.col("text")), begins)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))
    known = terms.select("term").distinct().withColumn("stem", stems(F.col("term"))).filter(F.col("stem").isin(wanted))
    rows = terms.join(known, "term").groupBy("id").agg(F.collect_set("stem").alias("_stems"), F.sum(F.when(~F.col("stem").isin(*without) if without else F.lit(True), F.col("n"))).cast("int").alias("tf"))
    met = [F.arrays_overlap("_stems", F.array(*map(F.lit, sorted(g)))) for g in groups] + [~F.array_contains("_stems", w) for w in sorted(without)]
    return rows.filter(reduce(lambda a, b: a & b, met)).select("id", "tf")


def keyword_search(df: DataFrame, query: str, k: int) -> DataFrame:
    """The k rows that meet a query and hold its words most often, with tf, ties by id; a query without words raises."""
    return top(df.join(term_hits(df, query), "id"), [F.desc("tf"), F.asc("id")], k)


def fused_search(df: DataFrame, vector: list[float], query: str, k: int, min_sim: float = 0.0, where: Column | None = None, said: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Reciprocal-rank fusion over df (id, code, text, embedding): the best k codes of the top 3k by vector and by keyword. said gives the keyword list (id, rank) of
    some ids, such as a search of an index does; df needs no text then.

    Scores are sums of 1 / (RRF_K + rank); ties go by vector rank, then keyword rank; rows under min_sim, whichever list
    they are of, go before one row a code is kept. Rows without a vector can't be compared and go too.
    """
    if where is not None:
        df = df.filter(where)
    df = df.select("id", "code", *["text"] * (said is None), cosine(F.col("embedding"), literal(vector)).alias("sim"))
    near = numbered(top(df.filter("sim IS NOT NULL"), [F.desc("sim"), F.asc("id")], 3 * k).select("id", "code", "sim"), [F.desc("sim"), F.asc("id")], "rank")
    if said is None:
        words = numbered(keyword_search(df, query, 3 * k).select("id", "code", "sim", "tf"), [F.desc("tf"), F.asc("id")], "rank").drop("tf")
    else:
        words = df.join(F.broadcast(said(df.select("id"), 3 * k).select("id", "rank")), "id").select("id", "code", "sim", "rank")  # 3k rows
    both = near.withColumn("arm", F.lit("v")).unionByName(words.withColumn("arm", F.lit("k")))
    fused = both.groupBy("id", "code").agg(
        F.max("sim").alias("sim"),
        F.sum(1.0 / (F.col("rank") + RRF_K)).alias("score"),
        F.min(F.when(F.col("arm") == "v", F.col("rank"))).alias("v_rank"),
        F.min(F.when(F.col("arm") == "k", F.col("rank"))).alias("k_rank"),
    )
    order = [F.desc("score"), F.asc_nulls_last("v_rank"), F.asc_nulls_last("k_rank")]
    first = F.row_number().over(Window.partitionBy("code").orderBy(*order))
    return top(fused.filter(F.col("sim") >= min_sim).withColumn("_n", first).filter("_n = 1").drop("_n"), order, k)


def rerank(candidates: DataFrame, score: Column | Callable[[pd.Series], pd.Series] | None, order: list[Column], text: str = "text", group: str | None = None) -> DataFrame:
    """Candidates by score, equal ones in the order they had; without a score as they were.

    score is a column, or a function of a batch of texts that may fail (a model, say): candidates of a question (group; all, without one) of which any score fails, or
    of which there is only one, stay as they were. Nothing is added or removed.
    """
    if score is None:
        return candidates.orderBy(*order)
    if isinstance(score, Column):
        return candidates.orderBy(F.desc(score), *order)

    def tried(texts: pd.Series) -> pd.Series:
        try:
            found = pd.Series(score(texts.fillna("")), dtype="float64")
            return found if len(found) == len(texts) else pd.Series([None] * len(texts), dtype="float64")
        except Exception:  # whatever a caller's scorer raises
            return pd.Series([None] * len(texts), dtype="float64")

    own = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))  # the few candidates of a question
    scored = candidates.withColumn("_score", F.pandas_udf(tried, "double")(F.col(text)))
    scored = scored.withColumn("_whole", (F.count("_score").over(own) == F.count(F.lit(1)).over(own)) & (F.count(F.lit(1)).over(own) > 1))
    return scored.orderBy(*([group] if group else []), F.desc_nulls_last(F.when(F.col("_whole"), F.col("_score"))), *order).drop("_score", "_whole")


def arbitrated(own_top: Column, other_top: Column, low: float, high: float, is_filter: Column) -> Column:
    """own or other: other where own results are weak (under low, or an empty filter) and the other corpus is stronger (or at high)."""
    weak = ~is_filter & (F.coalesce(own_top, F.lit(-1.0)) < low) & (other_top > F.coalesce(own_top, F.lit(-1.0)))
    return F.when(weak | (is_filter & own_top.isNull() & (other_top >= high)), "other").otherwise("own")
