"""Exact top-k inner products against brute force: ties, copies, odd rows, huge weights, several shards and groups of shards."""

import math
import random

import numpy as np
import pytest

from lodestone.llm import block_search


def floors(x, scale=64):
    return [math.floor(scale * float(v)) for v in x]


def brute(rows, every, top, scale=64):
    """rows (vec_id, vector) that take part; of equal rows one query, and all of them candidates."""
    out = []
    for q, x in dict.fromkeys((i, tuple(x)) for i, x in rows if i % every == 0):
        a = floors(x, scale)
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(u * v for u, v in zip(a, floors(y, scale))))), i) for i, y in rows if i != q)
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:top])]
    return sorted(out)


def plain(found):
    return sorted((x.query_id, x.rank, x.vec_id, x.score) for x in found.collect())


ODD = [(2002, None), (2004, [math.nan] * 4), (2005, [None] * 4), (2006, [math.inf, 1.0]), (None, [1.0] * 16)]


def test_against_brute_force(spark):
    rng = random.Random(8)
    good = [(i, [rng.gauss(0, 0.3) for _ in range(16)]) for i in range(900)]
    good += [(2000, good[0][1]), (2001, good[0][1]), (2003, [0.0] * 16), (2020, [1.0]), (2040, []), (2060, [0.5] * 20), good[40], good[40], (60, good[7][1])]
    df = spark.createDataFrame([(*r, "x", 3) for r in good + ODD], "vec_id long, embedding array<double>, shard string, centre int").repartition(5)
    assert plain(block_search.top_products(df)) == brute(good, 20, 20)
    assert block_search.top_products(df.limit(0)).count() == 0
    assert plain(block_search.top_products(df.filter("vec_id IN (0, 3)"))) == brute([good[0], good[3]], 20, 20)
    assert block_search.top_products(df.filter("vec_id = 7")).count() == 0


@pytest.mark.parametrize("big", [3e4, 1e14, 1e30])
def test_huge_weights(spark, big):
    rng = random.Random(3)
    good = [(i, [rng.choice([-1, 1]) * big * rng.random() for _ in range(5)]) for i in range(90)] + [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(90, 130)]
    assert plain(block_search.top_products(spark.createDataFrame(good, "vec_id long, embedding array<double>"), every=10, top=7)) == brute(good, 10, 7)


def test_shards_blocks_and_copies(spark, monkeypatch):
    """Small blocks, tiles and groups of shards; a third of the rows hold one vector, so that many scores tie at every border."""
    for name, value in {"BLOCK": 16, "SHARD": 64, "QUERY_TILE": 16, "SHARD_GROUP": 4}.items():
        monkeypatch.setattr(block_search, name, value)
    rng = random.Random(4)
    one = [rng.gauss(0, 0.2) for _ in range(8)]
    middle = [[rng.gauss(0, 0.4) for _ in range(8)] for _ in range(6)]
    good = [(i, one if i % 3 == 0 else [round(v + rng.gauss(0, 0.05), 1) for v in middle[i % 6]]) for i in range(1200)] + [(33, one)] * 30
    df = spark.createDataFrame(good, "vec_id long, embedding array<float>").repartition(4)
    good = [(r.vec_id, r.embedding) for r in df.collect()]
    assert plain(block_search.top_products(df, every=15, top=12)) == brute(good, 15, 12)


def test_blocks_are_left_out():
    """In rows that lie in heaps few products are made, and the result is that of all products."""
    rng = np.random.default_rng(5)
    heaps = np.repeat(rng.normal(0, 20, (64, 24)), 128, axis=0)
    x = np.floor(heaps + rng.normal(0, 1, heaps.shape))
    ids, starts = np.arange(len(x)), np.arange(0, len(x), 128)
    high, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
    q = x[::97]
    i, j, score, made = block_search.search_shard(q, ids[::97], np.full(len(q), -(2**63)), ids, x, high, low, np.append(starts[1:], len(x)), 20)
    every = (q @ x.T).astype(int)
    every[np.arange(len(q)), ids[::97]] = -(2**62)
    for k in range(len(q)):
        order = np.lexsort((ids, -every[k]))[:20]
        assert j[i == k].tolist() == order.tolist() and score[i == k].tolist() == every[k][order].tolist()
    assert made < 0.1 * len(q) * len(x)


def test_bounds_hold():
    rng = np.random.default_rng(6)
    for big in (10, 1e9, 1e20):
        x, q = np.floor(rng.normal(0, big, (200, 7))), np.floor(rng.normal(0, big, (20, 7)))
        limit = block_search.bounds(q, x.max(axis=0, keepdims=True), x.min(axis=0, keepdims=True))
        assert (limit[:, 0] >= block_search.products(q, x).max(axis=1)).all()
