"""Exact top-k inner products by block-at-a-time pruning.

A component is a term, a vector a document of such terms with whole weights floor(scale * x). Documents are put in an order in which like ones are close,
and cut into ranges: blocks of BLOCK rows, a partition of blocks a shard. A shard keeps its forward index (the rows' weights) and each block's
greatest and least weight of every term. What a block can score for a query at most is the sum, over the query's terms, of its weight times the block's
greatest (or, of a negative weight, least) one: its summed term maxima.

1. Each query scores the shard with the highest such sum; its k-th score there is a bound from below.
2. Other shards whose sum doesn't reach that bound are left out for the query. In a shard, the blocks come in the order of their sums, and are scored
   through the forward index until the next sum falls below the k-th score so far.

Sums and products are whole numbers and exact, so the result is, whatever is pruned; of equal scores the smaller vec_id counts as better, and only a sum strictly below the
k-th score ends a search. The order comes from centres fitted on at most FIT_ROWS vectors (those with the smallest hashes): it decides how much is pruned, not what is found.
Queries travel in tiles of QUERY_TILE rows, so that a shard is sent to each tile that needs it, once.

Defined results: a vector that is null or holds a null or non-finite component takes no part, nor one without a vec_id; vectors that differ in length are
compared as if the shorter went on with zeros; a zero or empty vector scores 0; rows with the query's own vec_id are not its candidates; of repeated rows each may be found;
a vec_id with several vectors is a query by each; scores beyond a long are held to its range; an empty table gives an empty table; only vec_id and embedding are
looked at, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import cut, discard, parallelism

EVERY = 20
TOP = 20
SCALE = 64
BLOCK = 256
#: Rows of a shard, about; of a tile of queries; shards whose maxima travel together.
SHARD, QUERY_TILE, SHARD_GROUP = 8192, 1024, 2048
FIT_ROWS = 4096
CENTRES = 128
#: Rows that go to Python at once, where a row holds a whole shard.
SHARDS_AT_ONCE = 4
SHARDS_PER_TASK = 64
_LONG = (-(2**63), 2**63 - 1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    e = F.col("embedding")
    df = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.filter(F.col("vec_id").isNotNull() & e.isNotNull() & ~F.coalesce(F.exists(e, bad), F.lit(True)))


def weights(rows: pd.Series, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of rows as a matrix of whole doubles, filled up with zeros."""
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return np.floor(out * scale)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The inner products of rows of q with rows of x, all whole numbers, without rounding: longs, or (where those don't hold them) held to a long's range."""
    most = np.abs(q).sum(axis=1).max(initial=0) * np.abs(x).max(initial=0)
    if most < 2**24:  # every partial sum is a whole number that the type holds
        return (q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, *_LONG).astype(np.int64)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block the sum of the query's weights times the block's greatest, or least, weights. Doubles; past 2^53 raised a little, never too low."""
    out = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    most = (np.abs(q).sum(axis=1)[:, None] * np.maximum(np.abs(high), np.abs(low)).max(axis=1, initial=0)[None, :]) if out.size else out
    return np.where(most < 2**53, out, np.minimum(out + most * 1e-9, float(_LONG[1])))


def fit(x: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Centres of directions, in an order in which neighbours are alike."""
    rng = np.random.default_rng(12)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    centres = unit[rng.permutation(len(unit))[: min(CENTRES, max(1, len(unit) // 8))]]
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    order, left = [0], list(range(1, len(centres)))
    while left:  # a walk from each centre to the nearest one that is left
        order.append(left.pop(int((centres[left] @ centres[order[-1]]).argmax())))
    return centres[order]


PACKED = "shard long, ids binary, rows binary, high binary, low binary, most binary, least binary, ends array<int>"


def _pack(batches: Iterator[pd.DataFrame], width: int, scale: float) -> Iterator[pd.DataFrame]:
    """Rows (shard, vec_id, embedding), in order of shard, as one row a shard; its last rows may wait for the next batch."""

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        x = weights(rows["embedding"], width, scale)
        starts = np.arange(0, len(x), BLOCK)
        high, low = (f(x, starts) if width else x[starts] for f in (np.maximum.reduceat, np.minimum.reduceat))
        kind = np.float32 if np.abs(x).max(initial=0) < 2**24 else np.float64
        columns = [x.astype(kind), high, low, high.max(axis=0), low.min(axis=0)]
        return pd.DataFrame([[int(rows["shard"].iloc[0]), rows["vec_id"].to_numpy(np.int64).tobytes(), *(v.tobytes() for v in columns), [*starts[1:].tolist(), len(x)]]], columns=[c.split()[0] for c in PACKED.split(", ")])

    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        for _, rows in pdf.groupby("shard", sort=False):
            if held and held[0]["shard"].iloc[0] != rows["shard"].iloc[0]:
                yield packed(pd.concat(held))
                held = []
            held.append(rows)
    if held:
        yield packed(pd.concat(held))


def _matrix(raw: bytes, n: int, width: int) -> np.ndarray:
    kind = np.float32 if len(raw) == 4 * n * width else np.float64
    return np.frombuffer(raw, dtype=kind).reshape(n, width).astype(np.float64)


def search_shard(q: np.ndarray, own: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, high: np.ndarray, low: np.ndarray, ends: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For queries (rows of q, with their vec_ids and the scores they must reach): rows of the result as query, place and score, and how many products were made.

    In step s every query whose search goes on scores the block that is the s-th by its bound; queries that want one block are one product.
    """
    starts = np.concatenate([[0], ends[:-1]])
    limit = bounds(q, high, low)
    order = np.argsort(-limit, axis=1, kind="stable")
    place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # rank by vec_id: of equal scores the smaller is better
    kept = np.full((len(q), top), -1, dtype=np.int64)
    score = np.full((len(q), top), _LONG[0], dtype=np.int64)
    kth = floor.astype(np.float64)
    going, made = np.arange(len(q)), 0
    for s in range(len(ends)):
        block = order[going, s]
        going = going[limit[going, block] >= kth[going]]
        if not len(going):
            break
        block = order[going, s]
        by_block = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(block[by_block]) != 0, [True]]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            asked, k = going[by_block[a:b]], block[by_block[a]]
            rows = np.arange(starts[k], ends[k])
            made += len(asked) * len(rows)
            new = products(q[asked], x[rows])
            better = new.max(axis=1) >= kth[asked]
            asked, new = asked[better], new[better]
            if not len(asked):
                continue
            mine = own[asked][:, None] == ids[rows][None, :]
            of = np.concatenate([kept[asked], np.where(mine, -1, rows[None, :])], axis=1)
            new = np.concatenate([score[asked], np.where(mine, _LONG[0], new)], axis=1)
            first = np.lexsort((place[of], ~new, of < 0), axis=1)[:, :top]
            kept[asked], score[asked] = np.take_along_axis(of, first, 1), np.take_along_axis(new, first, 1)
            full = kept[asked, -1] >= 0
            kth[asked] = np.where(full, np.maximum(kth[asked], score[asked, -1]), kth[asked])
    i, j = np.nonzero((kept >= 0) & (score >= floor[:, None]))
    return i, kept[i, j], score[i, j], made


FOUND = "tile long, i int, query_id long, vec_id long, score long"


def _search(batches: Iterator[pd.DataFrame], width: int, top: int) -> Iterator[pd.DataFrame]:
    """What shards hold for tiles' queries: a row is a tile, a shard, and which queries (wanted: i and floor) look there. Rows of a tile come side by side:
    what one shard has found is a floor for the next, and the top of all of them leaves the task."""
    tile, held, floors = None, None, {}
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.tile != tile:
                if held is not None:
                    yield held
                tile, held, floors = row.tile, None, {}
            asked, ids = np.frombuffer(row.q_ids, dtype=np.int64), np.frombuffer(row.ids, dtype=np.int64)
            at = np.array([w["i"] for w in row.wanted], dtype=np.int64)
            floor = np.array([max(w["floor"], floors.get(w["i"], w["floor"])) for w in row.wanted], dtype=np.int64)
            high, low = (np.frombuffer(v, dtype=np.float64).reshape(-1, width) for v in (row.high, row.low))
            i, j, score, _ = search_shard(_matrix(row.q_rows, len(asked), width)[at], asked[at], floor, ids, _matrix(row.rows, len(ids), width), high, low, np.array(row.ends), top)
            found = pd.DataFrame({"tile": row.tile, "i": at[i].astype(np.int32), "query_id": asked[at][i], "vec_id": ids[j], "score": score})
            if held is not None:
                found = pd.concat([held, found]).sort_values(["i", "score", "vec_id"], ascending=[True, False, True])
                found = found[found.groupby("i").cumcount() < top]
            full = found.groupby("i")["score"].agg(["size", "min"])
            held, floors = found, full.loc[full["size"] >= top, "min"].to_dict()
    if held is not None:
        yield held


WANTED = "tile long, shard long, wanted array<struct<i: int, floor: long>>"


def _wanted(batches: Iterator[pd.DataFrame], width: int, seed: bool) -> Iterator[pd.DataFrame]:
    """The shards that a tile's queries need: to begin with, of each group of shards the one with the highest bound; later all that reach the floors."""
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            n = len(row.q_ids) // 8
            shard, floor = np.array([s["shard"] for s in row.shards]), np.full(n, _LONG[0])
            high, low = (np.stack([np.frombuffer(s[k], dtype=np.float64) for s in row.shards]) for k in ("most", "least"))
            limit = bounds(_matrix(row.q_rows, n, width), high, low)
            if seed:
                wanted = np.arange(len(shard))[None, :] == limit.argmax(axis=1)[:, None]
            else:
                for f in row.floors if row.floors is not None else []:
                    floor[f["i"]] = f["floor"]
                wanted = limit >= floor[:, None]
            out = [(row.tile, int(shard[k]), [{"i": int(i), "floor": int(floor[i])} for i in np.flatnonzero(wanted[:, k])]) for k in np.flatnonzero(wanted.any(axis=0))]
            if out:
                yield pd.DataFrame(out, columns=["tile", "shard", "wanted"])


def top_products(vectors: DataFrame, every: int = EVERY, top: int = TOP, scale: float = SCALE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: the top inner products of each row whose vec_id is divisible by every."""
    spark = vectors.sparkSession
    rows = cut(usable(vectors).groupBy("vec_id", "embedding").agg(F.count("*").alias("copies")), "terms-rows")
    asked = F.col("vec_id") % every == 0
    n, n_queries, width = rows.agg(F.count("*"), F.count(F.when(asked, 1)), F.max(F.size("embedding"))).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = rows.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(fit_rows).select("embedding").toPandas()
    centres = spark.sparkContext.broadcast(fit(weights(sample["embedding"], width, scale)))
    nearest = F.pandas_udf(lambda e: pd.Series((weights(e, width, scale) @ centres.value.T).argmax(axis=1)), "int")
    # The order: by centre, then by a number below 1 that a hash gives.
    placed = rows.select("vec_id", "embedding", "copies", nearest("embedding").alias("centre"), (F.pmod(F.xxhash64("embedding", "vec_id"), F.lit(1 << 30)) / (1 << 30)).alias("along"))
    placed = cut(placed, "terms-placed")

    def packs(df: DataFrame, n: int, least: int, most: int, label: str) -> DataFrame:
        size = min(most, max(least, -(-n // parallelism(spark))))
        counts = {r["centre"]: r["count"] for r in df.groupBy("centre").count().collect()}  # CENTRES rows at most
        held = [counts.get(c, 0) for c in range(max(counts) + 1)]
        before, own = (F.get(F.array(*map(F.lit, x)), F.col("centre")) for x in (np.cumsum([0, *held])[:-1].tolist(), held))
        # A row's place among all, about: the rows of the centres before its own, and its part of those of its own.
        df = df.select(F.floor((before + F.col("along") * own) / size).alias("shard"), "vec_id", "embedding", "centre", "along")
        df = df.repartition(parallelism(spark), "shard").sortWithinPartitions("shard", "centre", "along", "vec_id")
        return cut(df.mapInPandas(lambda b: _pack(b, width, scale), PACKED), label)

    # Of a row that repeats, as many as a result can hold.
    shards = packs(placed.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(top))))), n, 4 * BLOCK, SHARD, "terms-shards")
    tiles = packs(placed.filter(asked), n_queries, BLOCK, QUERY_TILE, "terms-tiles").select(F.col("shard").alias("tile"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    n_shards, n_tiles = shards.agg(F.max("shard")).first()[0] + 1, tiles.count()
    groups = -(-n_shards // SHARD_GROUP)
    maxima = shards.groupBy((F.col("shard") % groups).alias("g")).agg(F.collect_list(F.struct("shard", "most", "least")).alias("shards"))  # SHARD_GROUP rows at most
    grid = tiles.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).join(maxima, "g")

    def searched(wanted: DataFrame, label: str) -> DataFrame:
        """The shards of a tile are dealt to few tasks, SHARDS_PER_TASK or so to each."""
        pieces = max(-(-n_shards // SHARDS_PER_TASK), -(-parallelism(spark) // n_tiles))
        pairs = wanted.join(tiles.withColumnRenamed("tile", "_t"), F.col("tile") == F.col("_t")).join(shards.drop("most", "least").withColumnRenamed("shard", "_s"), F.col("shard") == F.col("_s"))
        pairs = pairs.drop("_t", "_s").repartition(parallelism(spark), "tile", F.pmod(F.xxhash64("shard"), F.lit(pieces))).sortWithinPartitions("tile", "shard")
        return cut(pairs.mapInPandas(lambda b: _search(b, width, top), FOUND), label, batch=SHARDS_AT_ONCE)

    seeds = cut(grid.mapInPandas(lambda b: _wanted(b, width, True), WANTED), "terms-seeds", batch=SHARDS_AT_ONCE)
    near = searched(seeds, "terms-near")
    order = Window.partitionBy("tile", "i").orderBy(F.desc("score"), "vec_id")
    floors = near.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") == top).groupBy("tile").agg(F.collect_list(F.struct("i", F.col("score").alias("floor"))).alias("floors"))  # QUERY_TILE rows at most
    more = grid.join(floors, "tile", "left").mapInPandas(lambda b: _wanted(b, width, False), WANTED)
    done = seeds.select(F.col("tile").alias("_t"), F.col("shard").alias("_s"), F.transform("wanted", lambda w: w["i"]).alias("_done"))
    more = more.join(done, (F.col("tile") == F.col("_t")) & (F.col("shard") == F.col("_s")), "left")
    more = more.withColumn("wanted", F.filter("wanted", lambda w: ~F.coalesce(F.array_contains("_done", w["i"]), F.lit(False)))).filter(F.size("wanted") > 0)
    more = cut(more.select("tile", "shard", "wanted"), "terms-wanted", batch=SHARDS_AT_ONCE)
    far = searched(more, "terms-far")
    out = near.unionByName(far).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = cut(out.select("query_id", "rank", "vec_id", "score"), "terms-top")
    discard(rows, placed, shards, seeds, near, more, far)
    return out
