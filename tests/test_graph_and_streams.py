"""The graph of vectors at growing sizes, and bounded state on a stream."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph_index
from lodestone.plans.streams import _STORE, in_batches, run, settings
from lodestone.streaming import joins, limiter


def walked(spark, x, every):
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "embedding": x.tolist()}), "id long, embedding array<double>")
    rows, edges = graph_index.build(df)
    found, compared = graph_index.search(rows, edges, rows.filter(F.col("id") % every == 0), 5, beam=48, width=16)
    found, unit = found.toPandas(), x / np.linalg.norm(x, axis=1, keepdims=True)
    hits, asked = 0, range(0, len(x), every)
    for q in asked:
        sim = unit @ unit[q]
        sim[q] = -9
        own = found[found["query_id"] == q].sort_values("rank")
        hits += len(set(own["id"]) & set(np.argsort(-sim)[:5].tolist()))
        assert np.allclose(own["sim"], sim[own["id"]]) and (np.diff(own["sim"]) <= 1e-12).all()
    assert compared.count() == compared.distinct().count()
    return hits / 5 / len(asked), compared.count() / len(asked) / len(x)


def test_walks_compare_a_falling_share(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(40, 16))
    shares = []
    for n in (600, 1800, 5400):
        recall, share = walked(spark, middle[rng.integers(0, 40, n)] + 0.6 * rng.normal(size=(n, 16)), n // 30)
        assert recall >= 0.9, (n, recall)
        shares.append(share)
    assert shares[0] > 1.5 * shares[1] > 2.25 * shares[2], shares


def test_graph_takes_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(graph_index, "CELL", 8)
    monkeypatch.setattr(graph_index, "MOST", 16)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(90)] + [(5, [0.0, 1.0, 0.0]), (200, None), (201, [0.0] * 3), (None, [1.0] * 3)]
    vectors, edges = graph_index.build(spark.createDataFrame(rows, "id long, embedding array<double>"), links=6)
    assert vectors.count() == 90 and edges.filter("id = to").isEmpty()
    assert edges.groupBy("id").count().agg(F.max("count")).first()[0] <= 12
    found, _ = graph_index.search(vectors, edges, vectors.filter("id IN (0, 1)"), 4, beam=40)
    assert found.groupBy("query_id").count().filter("count <> 4").isEmpty()
    assert graph_index.build(spark.createDataFrame([], "id long, embedding array<double>"))[1].isEmpty()


def test_bounded_state(spark):
    """More keys than the state may hold, over time: it never holds more, and decisions are those of a window."""
    rng = random.Random(3)
    rows = [(i, f"k{i // 12 * 3 + rng.randrange(5)}", f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00") for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, user_id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    parts = [df.filter((F.col("event_id") >= a) & (F.col("event_id") < a + 60)) for a in range(0, 600, 60)]
    wanted = {r.event_id: r.allowed for r in limiter.window_allowed(df, "user_id", 600, 2).collect()}
    with settings(spark, _STORE):
        found = run(spark, limiter.bounded_allowed(in_batches(spark, parts), "user_id", 600, 2, 48, shares=4))[0].collect()
    assert {r.event_id: r.allowed for r in found} == wanted
    assert max(r.held for r in found) <= 12 < df.select("user_id").distinct().count() / 4
    with pytest.raises(ValueError):
        limiter.bounded_allowed(df, "user_id", 600, 2, 3, shares=4)


def test_stream_join_counts_what_is_late(spark):
    rows = lambda xs: spark.createDataFrame(xs, "event_id long, u long, kind string, ts string").withColumn("ts", F.to_timestamp("ts"))
    parts = [
        rows([(1, 1, "a", "2024-01-01 00:00:00"), (2, 1, "b", "2024-01-01 00:05:00"), (3, 2, "a", "2024-01-01 00:06:00")]),
        rows([(4, 1, "b", "2024-01-01 02:00:00"), (5, 2, "a", "2024-01-01 02:00:00")]),
        rows([(8, 5, "a", "2024-01-01 02:30:00"), (9, 5, "b", "2024-01-01 02:30:01")]),
        rows([(6, 2, "b", "2024-01-01 00:07:00"), (7, 9, "a", "2024-01-01 00:00:01")]),  # too late: rows are held against the time that stood when the batch before began
        rows([(-1, -1, "a", "2024-01-03 00:00:00"), (-2, -2, "b", "2024-01-03 00:00:00")]),
    ]
    stream = in_batches(spark, parts)
    with settings(spark, {"spark.sql.streaming.noDataMicroBatches.enabled": "true"}):
        found, ended = run(spark, joins.followed(stream.filter("kind = 'a'"), stream.filter("kind = 'b'"), "u", 600, "10 minutes"))
    assert sorted(map(tuple, found.filter("event_id > 0").collect()), key=str) == [(1, 2), (3, None), (5, None), (8, 9)]
    assert joins.dropped(ended) == 2
