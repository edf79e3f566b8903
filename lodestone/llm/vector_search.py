"""Nearest neighbours by anisotropic quantisation: four-bit table scans, then exact comparison of all that the codes can't rule out.

Nearness by Euclidean distance is a maximum of q.x - |x|^2 / 2, whatever point both are measured from: they are measured from the sample's mean. A residual of the
quantisation that lies along x changes the product with those queries for which x scores high, so the codebooks weigh it ETA times as much as one
across x. A vector is cut into pairs of components, each coded by one of 16 words (four bits); two codes share a byte, and |x|^2 / 2 stands beside them as it is. A scan adds up
table entries by byte. The best rows of a block for a query are compared first, in double precision, on the original vectors: the distance of the last that
may be wanted is a bound. A row's distance is at least that of the point which its codes stand for, less what the codes leave of it (both known, rounding allowed for);
only rows for which this exceeds the bound are ruled out, and all others are compared too. So the nearest are found whatever the vectors are like; how many rows are
compared depends on them. A comparison ends at the component where its sum passes the bound.

The codebooks are fitted on the driver on at most fit_rows vectors (those with the smallest hashes); all vectors are coded and
searched. Equal vectors are searched as one. Queries meet codes in blocks: both sides are dealt to block numbers, and each pair of
blocks is one group of a bounded size, to which codes go together with the vectors. A group hands on, for each query, only what may be among its nearest.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component takes no part, nor one without a vec_id, nor one
whose length isn't the most frequent length (of equals the shortest); rows with the query's own vec_id are not its candidates;
of repeated rows each may be found; a vec_id with several vectors is a query by each; ties go to the smaller vec_id; an empty table gives an
empty table; only vec_id and embedding are looked at, whatever other columns are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.llm.common import cut, discard, parallelism

EVERY = 100
TOP = 10
POOL = 400
ETA = 3.0
WORDS = 16
FIT_ROWS = 8000
ROUNDS = 8
QUERY_BLOCK = 1024
#: Vectors of a block, at least and at most (fewer if they are long: BLOCK_VALUES components), queries that are scored together, components that are compared together.
CANDIDATE_BLOCK = (2048, 32768)
BLOCK_VALUES = 1 << 22
STRIP = 64
STEP = 8
#: What a rounded value may be off by, in parts of it: of float tables, and of vectors measured from the mean.
FLOAT, DOUBLE = 2.0**-23, 2.0**-48


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    e = F.col("embedding")
    df = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    df = df.filter(F.col("vec_id").isNotNull() & e.isNotNull() & ~F.coalesce(F.exists(e, bad), F.lit(True)) & F.exists(e, lambda x: x != 0))
    size = df.groupBy(F.size(e).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return df.filter(F.size(e) == (size[0]["n"] if size else 0))


def _parts(x: np.ndarray) -> np.ndarray:
    """Rows as pairs of components (the last padded with a zero), and pairs up to an even number of them."""
    pad = -x.shape[1] % 4
    return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, 2)


def _unit(p: np.ndarray) -> np.ndarray:
    return p / np.maximum(np.sqrt((p * p).sum(axis=(1, 2), keepdims=True)), 1e-300)


def encode(x: np.ndarray, books: np.ndarray, eta: float = ETA, sweeps: int = 2) -> np.ndarray:
    """Codes of rows: per pair first the nearest word, then the word with the least anisotropic loss given the other pairs."""
    p = _parts(x)
    unit = _unit(p)
    n, m = p.shape[:2]
    codes = np.empty((n, m), dtype=np.uint8)
    along = np.zeros(n)
    rows = np.arange(n)
    cost, part = np.empty((m, n, WORDS)), np.empty((m, n, WORDS))
    for j in range(m):
        r = p[:, j, None, :] - books[j][None]
        cost[j], part[j] = (r * r).sum(axis=2), (r * unit[:, j, None, :]).sum(axis=2)
        codes[:, j] = cost[j].argmin(axis=1)
        along += part[j][rows, codes[:, j]]
    for _ in range(sweeps):
        for j in range(m):
            rest = along - part[j][rows, codes[:, j]]
            codes[:, j] = (cost[j] + (eta - 1) * (rest[:, None] + part[j]) ** 2).argmin(axis=1)
            along = rest + part[j][rows, codes[:, j]]
    return codes


def fit(x: np.ndarray, eta: float = ETA, rounds: int = ROUNDS) -> np.ndarray:
    """Books of WORDS words for each pair. A word is the solution of the anisotropic least squares of its rows' own parts."""
    p = _parts(x)
    unit = _unit(p)
    rng = np.random.default_rng(3)
    books = p[rng.permutation(len(p))[np.arange(WORDS) % len(p)]].transpose(1, 0, 2).copy()
    for _ in range(rounds):
        codes = encode(x, books, eta)
        for j in range(p.shape[1]):
            for k in range(WORDS):
                own = codes[:, j] == k
                if own.any():
                    u = unit[own, j]
                    a = own.sum() * np.eye(2) + (eta - 1) * u.T @ u
                    b = p[own, j].sum(axis=0) + (eta - 1) * (u * (u * p[own, j]).sum(axis=1, keepdims=True)).sum(axis=0)
                    books[j, k] = np.linalg.solve(a, b)
    return books


def pack(codes: np.ndarray) -> np.ndarray:
    return (codes[:, ::2] << 4) | codes[:, 1::2]


def tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """For each byte of a code and each of its values, the products with all queries."""
    single = np.einsum("qmd,mkd->mkq", _parts(q), books).astype(np.float32)
    return (single[::2, :, None, :] + single[1::2, None, :, :]).reshape(len(single) // 2, WORDS * WORDS, len(q))


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The points that codes stand for, as pairs of components."""
    return books[np.arange(codes.shape[1]), codes]


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def described(x: np.ndarray, mean: np.ndarray, scale: float, books: np.ndarray) -> dict[str, np.ndarray]:
    """Of vectors: packed codes, half the squared length, the squared length of the point that the codes stand for, and how far it may lie off at most."""
    with np.errstate(all="ignore"):
        own = (x - mean) / scale
        codes = encode(own, books)
        point = decode(codes, books)
        off = _parts(own) - point
        gap = np.sqrt((off * off).sum(axis=(1, 2))) * (1 + 1e-9) + DOUBLE * (_lengths(x) + _lengths(mean[None])) / scale
        return {"code": pack(codes), "half": 0.5 * (own * own).sum(axis=1), "square": (point * point).sum(axis=(1, 2)), "gap": gap}


def _distances(columns: np.ndarray, rows: np.ndarray, q: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows (of vectors by component) within the bound of q, and their distances, summed from the first component to the last."""
    total = np.zeros(len(rows))
    for begin in range(0, len(columns), STEP):
        for j in range(begin, min(begin + STEP, len(columns))):
            apart = columns[j, rows] - q[j]
            total += apart * apart
        near = ~(np.sqrt(total) > bound)
        if not near.all():
            rows, total = rows[near], total[near]
    return rows, np.sqrt(total)


def best(codes: dict[str, np.ndarray], x: np.ndarray, low: np.ndarray, queries: np.ndarray, model: tuple, pool: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the top nearest of the rows x (described by codes), nearest first and equal ones by low, and their distances."""
    mean, scale, books = model
    columns, packed, n = np.ascontiguousarray(x.T), codes["code"], len(x)
    reach = np.sqrt(codes["square"])
    first = max(pool, top)
    for begin in range(0, len(queries), STRIP):
        asked = queries[begin : begin + STRIP]
        with np.errstate(all="ignore"):
            own = (asked - mean) / scale
            look = tables(own, books)
            product = np.zeros((n, len(asked)), dtype=np.float32)
            for j in range(packed.shape[1]):
                product += look[j][packed[:, j]]
            product = product.T.astype(np.float64)
            score = np.nan_to_num(product - codes["half"], nan=-np.inf)
            length = _lengths(own)
            blur = (2 * packed.shape[1] + 8) * FLOAT
            for q, line, of, size in zip(asked, product, score, length, strict=True):
                rows = np.argpartition(-of, first - 1)[:first] if n > first else np.arange(n)
                _, far = _distances(columns, rows, q, np.inf)
                bound = np.partition(far, top - 1)[top - 1] if len(far) > top - 1 else np.inf
                if n > first:
                    most = bound / scale * (1 + 1e-9) + DOUBLE * (_lengths(q[None])[0] + _lengths(mean[None])[0]) / scale
                    square = size * size + codes["square"] - 2 * line
                    out = (square > (most + codes["gap"]) ** 2 * (1 + 1e-9) + blur * (size + reach) ** 2) & np.isfinite(line)
                    rows = np.flatnonzero(~out)
                rows, far = _distances(columns, rows, q, bound)
                order = np.lexsort((low[rows], far))[:top]
                yield rows[order], far[order]


def nearest(vectors: DataFrame, every: int = EVERY, top: int = TOP, pool: int = POOL, fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: the top nearest found of each row whose vec_id is divisible by every."""
    spark = vectors.sparkSession
    rows = usable(vectors).groupBy("vec_id", "embedding").agg(F.count("*").alias("copies"))
    # Two hashes stand for a vector.
    rows = cut(rows.withColumns({"v": F.xxhash64("embedding"), "w": F.xxhash64(F.lit(1), "embedding")}), "vectors")
    is_query = F.col("vec_id") % every == 0
    distinct = rows.groupBy("v", "w").agg(F.first("embedding").alias("embedding"), F.max(is_query).alias("asked"), F.min("vec_id").alias("low"))
    distinct = cut(distinct, "vectors-distinct")
    sample = distinct.orderBy("v", "w").limit(fit_rows).select("embedding").toPandas()
    n, n_queries = distinct.count(), distinct.filter("asked").count()
    if not len(sample) or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.stack(sample["embedding"])
    width = sample.shape[1]
    mean = (sample / len(sample)).sum(axis=0)
    sample = sample - mean
    largest = np.abs(sample).max() or 1.0
    scale = largest * np.sqrt(((sample / largest) ** 2).sum(axis=1).mean()) or 1.0
    model = spark.sparkContext.broadcast((mean, scale, fit(sample / scale)))
    # Floats are sent as they came, which loses nothing.
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["embedding"])
                own = described(x, *model.value)
                code, raw = ([r.tobytes() for r in a] for a in (own.pop("code"), x.astype(kind)))
                yield pd.DataFrame({"v": pdf["v"], "w": pdf["w"], "low": pdf["low"], "code": code, "x": raw} | own)

    small, large = CANDIDATE_BLOCK
    large = max(1, min(large, BLOCK_VALUES // width))
    c_blocks, q_blocks = max(-(-n // large), min(parallelism(spark), -(-n // small))), -(-n_queries // QUERY_BLOCK)
    # A query leaves out the rows of its own vec_id, which are top short of `most` at most.
    most = top + (rows.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0)
    # Vectors are dealt at random: a block holds its part of a query's pool, give or take.
    share = min(pool, math.ceil(pool / c_blocks + 5 * math.sqrt(pool / c_blocks)) + top)
    dealt = lambda blocks: F.pmod(F.xxhash64(F.lit(2), "v"), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    codes = distinct.select("v", "w", "low", "embedding").mapInPandas(coded, "v long, w long, low long, code binary, x binary, half double, square double, gap double")
    c = codes.select(dealt(c_blocks).alias("c"), each(q_blocks).alias("q"), "v", "w", "low", "code", "x", "half", "square", "gap")
    q = distinct.filter("asked").select(each(c_blocks).alias("c"), dealt(q_blocks).alias("q"), "v", "w", "embedding")

    def scan(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"v": [], "w": [], "x": [], "y": [], "low": [], "score": []}).astype({k: "int64" for k in ("v", "w", "x", "y", "low")})
        whole = lambda name, kind: np.frombuffer(b"".join(left[name]), dtype=kind).reshape(len(left), -1)
        own = {k: left[k].to_numpy() for k in ("half", "square", "gap")} | {"code": whole("code", np.uint8)}
        low = left["low"].to_numpy()
        found = list(best(own, whole("x", kind).astype(np.float64), low, np.stack(right["embedding"]), model.value, share, most))
        at, far = (np.concatenate(x) for x in zip(*found, strict=True))
        asked = np.repeat(np.arange(len(right)), [len(x) for x, _ in found])
        keys = {k: right[k].to_numpy()[asked] for k in "vw"}
        return pd.DataFrame(keys | {"x": left["v"].to_numpy()[at], "y": left["w"].to_numpy()[at], "low": low[at], "score": far})

    found = c.groupBy("c", "q").cogroup(q.groupBy("c", "q")).applyInPandas(scan, "v long, w long, x long, y long, low long, score double")
    place = F.row_number().over(Window.partitionBy("v", "w").orderBy("score", "low"))
    pairs = cut(found.withColumn("_at", place).filter(F.col("_at") <= most).select("v", "w", "x", "y", "score"), "vectors-pool")
    # Of a vector only its first rows can be among the top.
    first = rows.select("v", "w", "vec_id", "copies", F.row_number().over(Window.partitionBy("v", "w").orderBy("vec_id")).alias("_at")).filter(F.col("_at") <= most)
    near = pairs.join(first.select(F.col("v").alias("_x"), F.col("w").alias("_y"), "vec_id", "copies"), (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")))
    near = near.withColumn("_at", F.row_number().over(Window.partitionBy("v", "w").orderBy("score", "vec_id"))).filter(F.col("_at") <= most)
    asked = rows.filter(is_query).select(F.col("v").alias("_v"), F.col("w").alias("_w"), F.col("vec_id").alias("query_id"))
    near = near.join(asked, (F.col("v") == F.col("_v")) & (F.col("w") == F.col("_w"))).filter("vec_id <> query_id")
    near = near.select("query_id", "v", "w", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(top)))))
    rank = F.row_number().over(Window.partitionBy("query_id", "v", "w").orderBy("score", "vec_id"))
    out = cut(near.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score"), "vectors-nearest")
    discard(rows, distinct, pairs)
    return out
