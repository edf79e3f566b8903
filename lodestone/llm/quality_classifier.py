"""Quality classifier: support vectors over n-gram indicators that are scaled by naive Bayes log-count ratios.

A text's indicators are its byte trigrams and its runs of one to three word shapes (case, digits, marks, length, repeats of
the word before), hashed to one of FEATURES numbers. Each indicator is scaled by the log ratio of its smoothed counts in good
and bad texts, rows are brought to unit length, and a linear hinge-loss model is fitted by dual coordinate descent. A logistic
curve, fitted on a quarter of the rows that the model has not seen, turns margins into scores.

The model is fitted on the driver, on at most max_rows labelled rows (those with the smallest hashes of doc_id): that is
the documented bound; only the numbers of their indicators are collected. Scoring is one pass over all whole texts.

Defined results: a null text counts as empty; an empty text has no indicators and gets the score of the bias; a label other than
0 or 1, or a null one, is not learnt from; where a label is missing all scores are the share of label 1, or 1.0 without
any label; several labels of a document all count; repeated rows are scored alike and learnt
from once; texts that share a doc_id share its labels; an empty table gives an empty table; a text of any length is scored whole; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MAX_ROWS = 3000
FEATURES = 1 << 16
ALPHA = 1.0
#: Of the loss of rows of the mean share of their label.
COST = 2.0
EPOCHS = 30

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KIND = np.full(256, 4, dtype=np.int64)  # marks
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[128:] = 3
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _hashed(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.uint64) * _MULT) >> np.uint64(48)).astype(np.int64)


def indicators(text: str | None) -> np.ndarray:
    """The numbers of a text's indicators, ascending."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    found = np.zeros(FEATURES, dtype=bool)
    wide = data.astype(np.uint32)
    if len(data) >= 3:
        found[_hashed((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:])] = True
    space = _SPACE[data]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(begins):
        ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
        kind = _KIND[data]
        kind[space] = 5
        seen = 0
        for k in range(5):
            total = np.concatenate([[0], np.cumsum(kind == k)])
            n = total[ends] - total[begins]
            seen = seen * 3 + np.minimum(n, 2)
        long = np.minimum((ends - begins) // 6, 3)
        powers = np.cumprod(np.full(len(data), 0x100000001B3, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * powers)])
        # A word's sum times the inverse power of its start depends on its bytes alone.
        value = (sums[ends] - sums[begins]) * _inverse_powers(len(data))[begins]
        same = np.concatenate([[False], value[1:] == value[:-1]])
        shape = (seen * 4 + long) * 2 + same
        found[_hashed(shape + (1 << 40))] = True
        if len(shape) > 1:
            two = shape[:-1] * 4096 + shape[1:]
            found[_hashed(two + (1 << 41))] = True
            if len(shape) > 2:
                found[_hashed(two[:-1] * 4096 + shape[2:] + (1 << 42))] = True
    return np.flatnonzero(found)


_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_POWERS = [np.ones(1, dtype=np.uint64)]


def _inverse_powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _INVERSE)]))
    return _POWERS[0]


def _log_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.full((2, FEATURES), ALPHA)
    for row, label in zip(rows, y, strict=True):
        counts[int(label > 0), row] += 1
    p = counts / counts.sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last: of the bias) that minimise |w|^2 / 2 + sum of cost times hinge loss: each step minimises the dual
    over one multiplier, which stays between 0 and the row's cost. Ends early once a round moves no multiplier by more than 1e-6 of its cost."""
    w, a = np.zeros(FEATURES + 1), np.zeros(len(rows))
    square = np.array([v @ v + 1 for v in values])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            row, v = rows[i], values[i]
            gradient = y[i] * (w[row] @ v + w[-1]) - 1
            new = min(max(a[i] - gradient / square[i], 0.0), cost[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[row] += step * v
                w[-1] += step
                moved = max(moved, abs(step) / cost[i])
                a[i] = new
        if moved <= 1e-6:
            break
    return w


def _scaled(rows: list[np.ndarray], ratio: np.ndarray) -> list[np.ndarray]:
    return [ratio[r] / max(1e-9, np.sqrt(ratio[r] @ ratio[r])) for r in rows]


def _fit_svm(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ratio = _log_ratio(rows, y)
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    return ratio, dual_coordinate_descent(rows, _scaled(rows, ratio), y, COST * 0.5 / share)


def _margins(rows: list[np.ndarray], ratio: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.array([w[r] @ v + w[-1] for r, v in zip(rows, _scaled(rows, ratio), strict=True)])


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with smoothed goals."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, b = np.stack([margin, np.ones(len(margin))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - goal))
        b = b - np.clip(step, -5, 5)
    return float(b[0]), float(b[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> dict:
    """A model of rows of indicators with labels 0 or 1."""
    y = np.where(labels == 1, 1.0, -1.0)
    if min((y > 0).sum(), (y < 0).sum()) < 4:
        return {"share": float((y > 0).mean()) if len(y) else 1.0}
    held = np.zeros(len(y), dtype=bool)
    for label in (-1.0, 1.0):
        held[np.flatnonzero(y == label)[::4]] = True
    part = lambda keep: [r for r, k in zip(rows, keep, strict=True) if k]
    slope, offset = _logistic(_margins(part(held), *_fit_svm(part(~held), y[~held])), y[held])
    ratio, w = _fit_svm(rows, y)
    return {"ratio": ratio.astype(np.float32), "weights": w.astype(np.float32), "slope": max(slope, 1e-3), "offset": offset}


def score(texts: pd.Series, model: dict) -> pd.Series:
    if "share" in model:
        return pd.Series(np.full(len(texts), model["share"]))
    ratio, w = model["ratio"], model["weights"]
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        row = indicators(text)
        v = ratio[row]
        margin = (w[row] @ v) / max(1e-9, np.sqrt(v @ v)) + w[-1]
        out[i] = 1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["offset"], -30, 30)))
    return pd.Series(out)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"key": pdf["_key"], "label": pdf["_label"], "row": [indicators(x).astype(np.int32).tobytes() for x in pdf["_text"]]})


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null doc_id is not learnt from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    """Fit on labels (doc_id, quality) of documents that are not held out."""
    label = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label"))
    label = label.filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id"))).withColumn("_key", F.xxhash64(F.lit(5), "_id"))
    picked = label.orderBy("_key", "_id", "_label").limit(max_rows)
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(picked), "_id")
    found = rows.select("_key", "_label", "_text").mapInPandas(_rows, "key long, label int, row binary").dropDuplicates(["key", "label", "row"])
    found = found.orderBy("key", "label", "row").limit(max_rows).toPandas()  # a doc_id may stand for many texts
    return fit([np.frombuffer(x, dtype=np.int32) for x in found["row"]], found["label"].to_numpy())


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, keep: list[str] | None = None) -> DataFrame:
    """keep (doc_id), held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows))
    scored = F.pandas_udf(lambda texts: score(texts, model.value), "double")
    df = docs.select(*(keep or ["doc_id"]), held_out(F.col("doc_id")).alias("held_out"), scored("text").alias("score"))
    return df.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
