"""Published loads, views, joins by order and whole-table windows against brute force, with odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ordered, ranges, sketches, views
from lodestone.sources.published import Published


def test_published(spark, tmp_path):
    at = Published(spark, f"file://{tmp_path}/t", keep=2)
    with pytest.raises(ValueError):
        at.read()
    with pytest.raises(ValueError):
        at.load(-1, lambda _: spark.range(1))
    assert at.batch() == -1 and at.load(0, lambda base: spark.range(3) if base is None else None)
    assert at.load(4, lambda base: base.select((F.col("id") + 10).alias("id"))) and at.batch() == 4
    assert not at.load(4, lambda base: spark.range(0)) and not at.load(2, lambda base: spark.range(0))
    assert sorted(r[0] for r in at.read().collect()) == [10, 11, 12]
    # Killed while the data are written, and between data and pointer: the old state stands, and the batch can run again.
    before = at.read()
    with pytest.raises(ZeroDivisionError):
        at.load(5, lambda base: 1 / 0)

    class Dies(Published):
        def _point(self, batch, folder):
            raise InterruptedError

    with pytest.raises(InterruptedError):
        Dies(spark, at.root).load(5, lambda base: spark.range(99))
    assert at.batch() == 4 and sorted(r[0] for r in at.read().collect()) == [10, 11, 12]
    assert at.load(5, lambda base: base.filter("id > 10")) and sorted(r[0] for r in at.read().collect()) == [11, 12]
    assert sorted(r[0] for r in before.collect()) == [10, 11, 12]  # a reader that began before still has its state
    for k in range(6, 10):
        at.load(k, lambda base: base)
    left = [x.name for x in (tmp_path / "t").iterdir() if x.name.startswith("state-")]
    assert len(left) == 2 and at.pointer()["folder"] in left and not [x for x in (tmp_path / "t").iterdir() if x.name.startswith("_current-")]


def test_views(spark, tmp_path):
    rng = random.Random(4)
    view = views.View(spark, f"file://{tmp_path}/v", ["k"], lambda rows: views.counted(rows, ["k"], ["x"]))
    held = []
    for batch in range(5):
        new = [(rng.choice([None, 1, 2, 3]), rng.randint(0, 9), 1) for _ in range(40)]
        gone = [(k, x, -1) for k, x, _ in rng.sample(held, len(held) // 3)]
        for k, x, _ in gone:
            held.remove((k, x, 1))
        held += new
        rows = spark.createDataFrame(new + gone, "k int, x long, sign long")
        assert view.apply(batch, rows) and not view.apply(batch, rows)
        wanted = {}
        for k, x, _ in held:
            n, s = wanted.get(k, (0, 0))
            wanted[k] = (n + 1, s + x)
        assert {r.k: (r.n, r.x) for r in view.read().collect()} == wanted
    assert view.check().isEmpty()
    view.apply(9, spark.createDataFrame([(77, 1, -1)], "k int, x long, sign long"))
    assert [r.k for r in view.check().collect()] == [77]


def intervals(rng, n, odd):
    out = [(i, rng.choice("ab"), lo := rng.randint(-500, 500), lo + int(rng.expovariate(0.05))) for i in range(n)]
    return out + odd


def test_interval_joins(spark):
    rng = random.Random(6)
    left = intervals(rng, 80, [(900, "a", -(2**40), 2**40), (901, "a", 5, 5), (902, "a", 9, 2), (903, None, 0, 9), (904, "a", None, 9), (905, "b", 0, None), (906, "a", 0, 1)])
    right = intervals(rng, 90, [(900, "b", -(2**50), 2**50), (901, "a", 0, 1), (901, "a", 0, 1)])
    points = [(i, rng.choice("ab"), rng.randint(-600, 600)) for i in range(100)] + [(500, "a", None), (501, None, 3), (502, "a", 2**39), (502, "a", 2**39)]
    a = spark.createDataFrame(left, "i long, k string, lo long, hi long").repartition(3)
    b = spark.createDataFrame(right, "j long, m string, low long, high long").repartition(3)
    p = spark.createDataFrame(points, "p long, q string, t long").repartition(3)
    whole = lambda lo, hi: lo is not None and hi is not None and lo < hi
    found = ranges.interval_join(p, "t", a, "lo", "hi", [("q", "k")])
    assert sorted((r.p, r.i) for r in found.collect()) == sorted((x, i) for x, q, t in points for i, k, lo, hi in left if t is not None and whole(lo, hi) and q is not None and q == k and lo <= t < hi)
    found = ranges.interval_join(p, "t", a, "lo", "hi")
    assert found.count() == sum(lo <= t < hi for _, _, t in points for _, _, lo, hi in left if t is not None and whole(lo, hi))
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    found = ranges.overlap_join(a, b, ("lo", "low"), ("hi", "high"), [("k", "m")])
    assert sorted((r.i, r.j) for r in found.collect()) == sorted((i, j) for i, k, lo, hi in left for j, m, low, high in right if whole(lo, hi) and whole(low, high) and k is not None and k == m and lo < high and low < hi)
    assert ranges.overlap_join(a.limit(0), b, ("lo", "low"), ("hi", "high")).count() == 0 and ranges.interval_join(p, "t", a.limit(0), "lo", "hi").count() == 0


@pytest.mark.parametrize("n", [1, 7])
def test_asof(spark, n):
    rng = random.Random(8)
    left = [(i, rng.choice("aaaab"), rng.randint(0, 300)) for i in range(200)] + [(900, None, 5), (901, "a", None), (902, "z", 5), (903, "a", -5), (1, "a", 7), (1, "a", 7)]
    right = [(rng.choice("aab"), rng.randint(0, 290), rng.randint(0, 9)) for _ in range(60)] + [(None, 5, 1), ("a", None, 2), ("a", 7, None)]
    a, b = spark.createDataFrame(left, "i long, k string, t long").repartition(3), spark.createDataFrame(right, "m string, at long, v long").repartition(2)

    def wanted(k, t):
        own = [(at, v is not None, v or 0, v) for m, at, v in right if k is not None and t is not None and m == k and at is not None and at <= t]
        return max(own)[3] if own else None

    found = ranges.asof_join(a, b, ("t", "at"), ("k", "m"), ["v"], ranges=n)
    assert sorted(((r.i, str(r.t), r.v) for r in found.collect()), key=str) == sorted(((i, str(t), wanted(k, t)) for i, k, t in left), key=str)
    assert ranges.asof_join(a.limit(0), b, ("t", "at"), ("k", "m"), ["v"]).count() == 0
    assert ranges.asof_join(a, b.limit(0), ("t", "at"), ("k", "m"), ["v"]).filter("v IS NOT NULL").count() == 0


def single(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "SinglePartition" in line]


def test_windows_over_a_whole_table(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice([None, rng.randint(0, 40)]), rng.choice([None, rng.randint(0, 9)])) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, x long, y long").repartition(4)
    for tiles in (3, 7, 600):
        found = sorted(ordered.ordered(df, [F.desc_nulls_first("x"), F.asc("i")], ["y"], ["y"], tiles, ranges=9).collect(), key=lambda r: r._number)
        wanted = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
        assert [(r.i, r.x, r.y) for r in found] == wanted and [r._number for r in found] == list(range(1, 501))
        total, size, more = None, 500 // tiles, 500 % tiles
        sizes = [size + 1] * more + [size] * (tiles - more)
        tile = [k + 1 for k, n in enumerate(sizes) for _ in range(n)]
        assert [r._tile for r in found] == tile
        for k, r in enumerate(found):
            total = total if r.y is None else (total or 0) + r.y
            assert r._sum_y == total and r._lag_y == (wanted[k - 1][2] if k else None) and r._lead_y == (wanted[k + 1][2] if k < 499 else None)
    out = ordered.ordered(df, [F.asc("x"), F.asc("i")], ["y"], ["y"], 4, ranges=9)
    out.collect()
    # What meets in one task is a row a range, never the table.
    assert all("l_" not in line and "y#" not in line.split("SinglePartition")[0] for line in single(out))
    assert ordered.ordered(df.limit(0), [F.asc("i")], ["y"]).count() == 0


def test_sketches(spark):
    rng = random.Random(12)
    rows = [(rng.choice("ab"), rng.choice("xyz"), rng.randint(0, 3000), rng.random()) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "a string, b string, v long, q double").repartition(4)
    parts = [sketches.kept(df.filter(F.col("v") % 3 == k), ["a", "b"], "v", "q") for k in range(3)]
    found = sketches.estimates(sketches.rolled_up(sketches.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["a", "b"]), ["a", "b"]), [0.25, 0.5]).collect()
    assert len(found) == 2 * 3 + 2 + 1
    for r in found:
        own = [x for x in rows if r.level < 1 or x[0] == r.a if r.level < 2 or x[1] == r.b]
        distinct = len({x[2] for x in own})
        assert r.n == len(own) and abs(r.n_distinct - distinct) <= sketches.DISTINCT_ERROR * distinct + 1
        for p, q in zip([0.25, 0.5], r.q):
            assert abs(sum(x[3] <= q for x in own) / len(own) - p) <= sketches.RANK_ERROR + 1 / len(own)
