"""SimHash near-dedup: fingerprints, a grid join on their segments' bit counts, exact verification, components.

A fingerprint's 32 segments of two bits are mapped to their bit counts (0, 1 or 2). The Manhattan distance of two such vectors is a
lower bound of the fingerprints' Hamming distance. The segments fall into groups, a few (`agree`) more than the distance allows; vectors
within the distance agree in that many groups at least, so each lies in one grid cell for every choice of so many groups, and close ones share a
cell. The more nodes there are, the more groups must agree: cells get finer, links stay the same. Pairs within a cell pass the bound and are then verified on the fingerprints.

Equal fingerprints are one node. Cells with more than BLOCK nodes are cut into blocks, and each pair of blocks is a group of its
own. A group hands on no more than a few links a node: a spanning forest of what it has verified.

Defined results: a null or empty text, or one without words, has the fingerprint 0; fewer words than a shingle are one shingle; a null
doc_id never names a component unless all its members' are null; repeated rows share a component; an empty table gives an
empty table; only doc_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import TEXTS, cut, discard, parallelism
from lodestone.llm.components import components

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Groups that must agree, at least and at most.
AGREE = (3, 8)
BLOCK = 1024
LANES = np.uint64(0x0101010101010101)
ODD = np.uint64(0x5555555555555555)


def shingles(text: str | None, size: int) -> list[bytes]:
    """Runs of size words (A-Z in lower case), joined by spaces; of fewer words the one run."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(size)), strict=False)]


def fingerprint(parts: list[bytes]) -> int:
    """64 bits, each 1 if set in over half of the hashes; 0 of none."""
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, SEED) for x in parts], dtype=np.uint64)
    n = len(hashes)
    hashes = np.concatenate([hashes, np.zeros(-n % 255, np.uint64)]).reshape(-1, 255)
    out = 0
    for bit in range(8):
        # Eight counts at once, one a byte: 255 rows can't overflow one.
        counts = ((hashes >> np.uint64(bit)) & LANES).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for lane in np.flatnonzero(2 * counts > n):
            out |= 1 << (8 * int(lane) + bit)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def agreeing(nodes: int, distance: int) -> int:
    """The fewest groups that leave about four nodes a cell: a segment's count carries 1.5 bits."""
    fine = (k for k in range(*AGREE) if nodes <= 4 * 2 ** (1.5 * 32 * k / (distance + k)))
    return next(fine, AGREE[1])


def _masks(distance: int, agree: int) -> list[int]:
    """For every choice of so many groups of segments, the bits of these."""
    groups = distance + agree
    bounds = [32 * i // groups for i in range(groups + 1)]
    own = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(bounds, bounds[1:], strict=False)]
    return [_signed(sum(x)) for x in combinations(own, agree)]


def _close(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (i < j) of one group within the distance, and the distances. Rows come in order of groups."""
    counts = fp - ((fp >> np.uint64(1)) & ODD)
    left, right, apart = [], [], []
    rows = np.arange(len(group))
    step = 1
    while True:
        rows = rows[rows + step < len(group)]
        rows = rows[group[rows] == group[rows + step]]
        if not len(rows):
            break
        keep = rows[_manhattan(counts[rows], counts[rows + step]) <= distance]
        h = np.bitwise_count(fp[keep] ^ fp[keep + step])
        ok = h <= distance
        left.append(keep[ok])
        right.append(keep[ok] + step)
        apart.append(h[ok])
        step += 1
    empty = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) if x else empty for x in (left, right, apart))


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distance of vectors of counts 0, 1 and 2, two bits each: 1 where the low bits differ, 2 where only the high bits do."""
    x = a ^ b
    low = x & ODD
    return np.bitwise_count(low) + 2 * np.bitwise_count((x >> np.uint64(1)) & ODD & ~low)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row of each row's component."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _links(batches: Iterator[pd.DataFrame], distance: int, nearest: int) -> Iterator[pd.DataFrame]:
    """Links of rows (_g: the group, node, fp) in order of groups; the last group of a batch waits for the next batch."""
    rest = None
    for last, pdf in _with_end(batches):
        pdf = pdf if rest is None else pd.concat([rest, pdf])
        keys = pdf["_g"].to_numpy()
        end = len(keys) if last or not len(keys) else int(np.flatnonzero(keys == keys[-1])[0])
        now, rest = pdf.iloc[:end], pdf.iloc[end:]
        if not len(now):
            continue
        group = np.cumsum(np.concatenate([[0], keys[1:end] != keys[: end - 1]]))
        node = now["node"].to_numpy()
        i, j, d = _close(group, now["fp"].to_numpy().view(np.uint64), distance)
        label = _forest(len(node), i, j)
        other = np.flatnonzero(label != np.arange(len(node)))
        a, b = node[other], node[label[other]]
        if nearest:  # besides the forest, the nearest few of each row
            rows, others, far = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([d, d])
            order = np.lexsort((others, far, rows))
            rows, others = rows[order], others[order]
            first = np.searchsorted(rows, rows)
            keep = np.arange(len(rows)) - first < nearest
            a, b = np.concatenate([a, node[rows[keep]]]), np.concatenate([b, node[others[keep]]])
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, pd.DataFrame]]:
    held = None
    for pdf in batches:
        if held is not None:
            yield False, held
        held = pdf
    if held is not None:
        yield True, held


def links(nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK, nearest: int = 0, agree: int | None = None) -> DataFrame:
    """Links (a, b) between nodes (node, fp; longs) whose fingerprints differ in distance bits at most: a forest of all such
    links, with the nearest few of each node beside it if asked for."""
    x, odd = F.col("fp"), F.lit(0x5555555555555555)
    high = F.shiftrightunsigned("fp", 1)
    counts = x.bitwiseXOR(high).bitwiseAND(odd).bitwiseOR(F.shiftleft(x.bitwiseAND(high).bitwiseAND(odd), 1))
    masks = _masks(distance, agree or agreeing(nodes.count(), distance))
    choices = F.array(*[F.struct(F.lit(i).alias("k"), F.col("_c").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)])
    cells = nodes.withColumn("_c", counts).select("node", "fp", F.explode(choices).alias("_x"))
    cells = cells.select("node", "fp", F.col("_x.k").alias("k"), F.col("_x.cell").alias("cell"))
    full = cells.groupBy(F.col("k").alias("_k"), F.col("cell").alias("_cell")).count().filter("count > 1")
    full = cut(full.select("_k", "_cell", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "grid-cells")
    rows = cells.join(full, (F.col("k") == F.col("_k")) & (F.col("cell") == F.col("_cell"))).withColumn("_own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("k", "cell", F.least("_own", "_o"), F.greatest("_own", "_o"))
    rows = rows.select(group.alias("_g"), "node", "fp").repartition(parallelism(nodes.sparkSession), "_g").sortWithinPartitions("_g", "node")
    return rows.mapInPandas(lambda b: _links(b, distance, nearest), "a long, b long")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp of every document."""
    own = F.pandas_udf(lambda texts: pd.Series([_signed(fingerprint(shingles(x, shingle))) for x in texts], dtype="int64"), "long")
    return docs.select("doc_id", own("text").alias("fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id, the least doc_id that links of the distance reach."""
    df = cut(fingerprints(docs, shingle), "fingerprints", batch=TEXTS)
    nodes = cut(df.groupBy("fp").agg(F.min("doc_id").alias("_least")).withColumn("node", F.col("fp")), "fingerprint-nodes")
    roots = components(links(nodes.select("node", "fp"), distance))
    roots = cut(roots.join(nodes, "node", "right").select("node", "_least", F.coalesce("root", "node").alias("root")), "fingerprint-roots")
    least = roots.groupBy(F.col("root").alias("_r")).agg(F.min("_least").alias("component_id"))
    known = cut(roots.join(least, F.col("root") == F.col("_r")).select("node", "component_id"), "fingerprint-components")
    discard(nodes, roots)
    df = df.join(known, F.col("fp") == F.col("node"))
    return df.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
