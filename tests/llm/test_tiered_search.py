"""Ranked search against brute force: odd rows, ties, repeated rows and items, long texts, several tiers, shards and blocks."""

import math
import random
import re

import pytest

from lodestone.llm import tiered_search


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, top=10):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n_docs, length = len(own), sum(len(t) for _, t in own)
    df: dict = {}
    for _, t in own:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, t in own:
            m = 25 + (75 * len(t) * n_docs) // length
            score = 0
            for w in terms(text):
                if tf := t.count(w):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


def plain(df):
    return sorted(((x.item_id, x.rank, x.doc_id, x.score) for x in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(300)]
    word = lambda: vocabulary[min(299, int(rng.expovariate(0.03)))]
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 120)))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, " .,-\t"), (1003, "É é漢字 W1_w2-W3 x"), (1004, "w299 " * 3000 + "w7"), (1005, docs[3][1]), docs[3], docs[3], (None, docs[3][1]), (None, "w1 w298 rare"), (3, "w299 other text"), (2**62 + 1, "w299 rare"), (-7, "w299 rare")]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 30)))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "unknown words"), (103, "w0 W0 w0 w1"), (104, "rare"), (105, docs[3][1]), (106, "É W1"), (106, "w299"), (None, "w298")]
    return docs, items


@pytest.fixture(scope="module")
def frames(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows[0]], "doc_id long, text string, row string, shard int").repartition(5)
    return docs, spark.createDataFrame([(*r, "x", 1) for r in rows[1]], "item_id long, text string, words string, i int").repartition(2)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(frames, rows, small, monkeypatch):
    if small:
        for name, value in {"SHARD_TERMS": 500, "SHARD_DOCS": 9, "ITEM_BLOCK": 30, "TRIED": 10, "SENT": 5}.items():
            monkeypatch.setattr(tiered_search, name, value)
    assert plain(tiered_search.ranked(*frames)) == brute(*rows)


def test_empty_tables(frames):
    docs, items = frames
    assert tiered_search.ranked(docs.limit(0), items).count() == 0
    assert tiered_search.ranked(docs, items.limit(0)).count() == 0
    assert tiered_search.ranked(docs.filter("text IS NULL"), items).count() == 0


def test_items_end_in_every_tier(spark, monkeypatch):
    """Rare words prove themselves on high tiers, common ones fall through; bounds hold for what each tier leaves."""
    rng = random.Random(2)
    docs = [(i, " ".join([f"c{rng.randint(0, 5)}" for _ in range(rng.randint(5, 60))] + ([f"r{i % 40}"] * rng.randint(1, 9) if i % 2 else []))) for i in range(1600)]
    items = [(i, f"r{i}") for i in range(10)] + [(20 + i, f"r{i} c{i % 6}") for i in range(10)] + [(40 + i, f"c{i} c{(i + 1) % 6} c{(i + 2) % 6}") for i in range(6)]
    index = tiered_search.tiered_index(spark.createDataFrame(docs, "doc_id long, text string"), (1 / 4, 1 / 16))
    ended = []
    run = tiered_search.Search.run
    monkeypatch.setattr(tiered_search.Search, "run", lambda self: (run(self), ended.extend(self.ended))[0])
    assert plain(tiered_search.search(index, spark.createDataFrame(items, "item_id long, text string"), 10, 3)) == brute(docs, items)
    assert len(ended) == sum(any(w in {x for _, d in docs for x in d.split()} for w in t.split()) for _, t in items) and {0, 2} <= set(ended)
    known = tiered_search.bounds(index, spark.createDataFrame([(w,) for w in {w for _, d in docs for w in d.split()}] + [("unknown",)], "term string"), 3).collect()
    weight = {r.term: r.weight for r in known}
    n_docs = sum(1 for _, d in docs if d)
    df = {w: sum(w in d.split() for _, d in docs) for w in weight}
    assert weight == {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for w, n in df.items()} and len(weight) == len({w for _, d in docs for w in d.split()})
    most: dict = {}
    for row in index.collect():
        for k in range(3):
            ends = row[f"ends{k}"]
            for j, t in enumerate(row[f"term{k}"].split()):
                for x in row[f"adds{k}"][ends[j - 1] if j else 0 : ends[j]]:
                    for above in range(k):
                        most[t, above] = max(most.get((t, above), 0), weight[t] * x)
    for r in known:
        assert list(r.residuals) == [most.get((r.term, k), 0) for k in range(3)]
