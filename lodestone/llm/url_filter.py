"""URL filter: rules by host and path, and a character language-model ratio where no rule fits.

Two variable-order Markov models, one of accepted and one of rejected URLs, are counted over all URLs that a rule
decides, but for a fifth that calibrates. A character's probability backs off from a context of four characters to none, each
order smoothed with the next shorter. The counts are a table of the distinct five-character runs, exact and as long as the corpus needs;
counts of shorter contexts are its sums. Each run's log-likelihood ratio is found once, and a URL's score is the sum over its runs, joined to that
table, by length; URLs under the calibrated threshold are blocked.

Defined results: a null URL has an empty host and path, no rule, and the score 0; where no URL is accepted by a rule, or
none rejected, the method allows all; repeated rows are judged alike; a null page_id is kept; an empty table gives an empty table; a URL of any
length is scored whole; only page_id and url are looked at, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, discard

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
ORDERS = 5
SMOOTH = 4.0
BINS, SPAN = 2001, 5.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. Rules are a short list of the caller's."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        h, slash, p = rule.partition("/")
        fits.append((((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p), rule, verdict))
    pick = lambda k: reduce(lambda a, x: a.when(x[0], F.lit(x[k])), fits, F) if fits else F.lit(None).cast("string")
    return pick(1), pick(2)


RUN = "x long, y long, run long, n long, good long, bad long"


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of URLs (x, y: the key, url, good, bad): the distinct runs of ORDERS bytes that end at each byte, the last lowest, and how many there are."""
    for pdf in batches:
        for begin in range(0, len(pdf), 2000):
            part = pdf.iloc[begin : begin + 2000]
            raw = [u.encode() for u in part["url"]]
            sizes = np.array([len(x) for x in raw], dtype=np.int64)
            pad = b"\0" * (ORDERS - 1)
            data = np.frombuffer(b"".join(pad + x for x in raw), dtype=np.uint8).astype(np.int64)
            own = np.repeat(np.arange(len(raw)), sizes)
            at = np.arange(len(own)) + (own + 1) * len(pad)
            run = sum(data[at - k] << (8 * k) for k in range(ORDERS)) if len(own) else at
            keys, n = np.unique((own << (8 * ORDERS)) | run, return_counts=True)
            rows = keys >> (8 * ORDERS)
            yield pd.DataFrame({"x": part["x"].to_numpy()[rows], "y": part["y"].to_numpy()[rows], "run": keys & ((1 << (8 * ORDERS)) - 1), "n": n, "good": part["good"].to_numpy()[rows], "bad": part["bad"].to_numpy()[rows]})


def ratios(runs: DataFrame) -> DataFrame:
    """run and ratio, the difference of the log-probabilities of its last byte after the others, of counts (run, good, bad)."""
    low = lambda x, n: x.bitwiseAND(F.lit((1 << (8 * n)) - 1))
    df, probability = runs, {k: F.lit(1 / 256) for k in ("good", "bad")}
    for order in range(ORDERS):
        after = low(F.shiftright("run", 8), order)
        for kind, key, size in (("c", low(F.col("run"), order + 1), order + 1), ("t", after, order)):
            sums = runs.groupBy(key.alias("_k")).agg(F.sum("good").alias(f"_{kind}good{order}"), F.sum("bad").alias(f"_{kind}bad{order}"))
            # Two bytes have 65,536 values at most.
            df = df.join(F.broadcast(sums) if size <= 2 else sums, key == F.col("_k")).drop("_k")
        probability = {k: (F.col(f"_c{k}{order}") + SMOOTH * p) / (F.col(f"_t{k}{order}") + SMOOTH) for k, p in probability.items()}
    return df.select("run", (F.log(probability["good"]) - F.log(probability["bad"])).alias("ratio"))


def scores(urls: DataFrame) -> DataFrame:
    """x, y and score of distinct URLs (x, y, url, good, bad: how often they count as accepted and rejected)."""
    runs = cut(urls.select("x", "y", "url", "good", "bad").mapInPandas(_runs, RUN), "url-runs")
    counts = cut(runs.groupBy("run").agg(F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("bad")).alias("bad")), "url-counts")
    known = cut(ratios(counts), "url-ratios")
    discard(counts)
    total = runs.select("x", "y", F.col("run").alias("_r"), "n").join(known, F.col("_r") == F.col("run")).groupBy("x", "y").agg(F.sum(F.col("n") * F.col("ratio")).alias("_sum"), F.sum("n").alias("_n"))
    out = cut(total.select("x", "y", F.round(F.col("_sum") / F.col("_n"), 9).alias("score")), "url-scores")
    discard(runs, known)
    return out


def calibrate(rows: DataFrame) -> float:
    """The threshold with the best balanced accuracy over rows (_label, _n: how many, score), next to 0 of equals; -inf where a label is missing."""
    at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + SPAN) / (2 * SPAN) * BINS)))
    found = rows.groupBy("_label", at.cast("int").alias("bin")).agg(F.sum("_n").alias("n")).collect()
    counts = np.zeros((2, BINS + 1))
    for x in found:
        counts[x["_label"], x["bin"]] += x["n"]
    if not counts.sum(axis=1).all():
        return -np.inf
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(counts, axis=1)], axis=1)[:, : BINS + 1]
    good = below[0] / counts[0].sum() + 1 - below[1] / counts[1].sum()
    edges = np.arange(BINS + 1) / BINS * 2 * SPAN - SPAN
    return float(min(edges[good >= good.max() - 1e-12], key=abs))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, score and verdict of every URL."""
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", F.lower(F.coalesce("url", F.lit(""))).alias("_url"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "_verdict": verdict})
    count = lambda v: F.sum((F.coalesce("_verdict", F.lit("")) == v).cast("long"))
    # Two hashes stand for a URL in the joins.
    urls = df.groupBy(F.col("_url").alias("url")).agg(count("allow").alias("_good"), count("block").alias("_bad"))
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    urls = urls.select("url", F.xxhash64("url").alias("x"), F.xxhash64(F.lit(1), "url").alias("y"), held.alias("_held"), "_good", "_bad")
    urls = cut(urls.withColumns({k: F.when(F.col("_held"), 0).otherwise(F.col(f"_{k}")) for k in ("good", "bad")}), "urls")
    scored = scores(urls)
    keyed = scored.withColumnsRenamed({"x": "_x", "y": "_y"})
    same = lambda x, y: (x == F.col("_x")) & (y == F.col("_y"))
    rows = urls.filter("_held").join(keyed, same(F.col("x"), F.col("y"))).select("score", F.explode(F.array(F.struct(F.lit(0).alias("_label"), F.col("_bad").alias("_n")), F.struct(F.lit(1).alias("_label"), F.col("_good").alias("_n")))).alias("_l"))
    threshold = calibrate(rows.select("score", "_l.*"))
    df = df.withColumns({"_x1": F.xxhash64("_url"), "_y1": F.xxhash64(F.lit(1), "_url")}).join(keyed, same(F.col("_x1"), F.col("_y1")), "left")
    df = df.withColumn("score", F.coalesce("score", F.lit(0.0)))
    return df.select("page_id", "host", "path", "rule", "score", F.coalesce("_verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"))
