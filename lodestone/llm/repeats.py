"""Suffix-array dedup: longest previous factors of all positions, by buckets of the suffix order.

A window is the first `length` bytes of a suffix. A position is a copy if its longest previous factor (the longest stretch from it that also
starts at an earlier position) reaches the length; without keep_first, also if its longest later factor does. Suffixes are
dealt to buckets in such a way that equal windows meet: a window goes by its anchor, the substring of `anchor` bytes with the least
hash in it (the leftmost of equals). Neighbouring windows mostly share their anchor, so a run of them travels as one segment.

1. Segments are made in one pass over the texts. Anchors that stand once have no copies and go. Segments that are equal (by a
   cryptographic digest of their bytes) are a kind; its first and its last one enter the bucket, and the copies between have the
   longest previous factors of the last.
2. In a bucket, suffixes that share what lies before the anchor are put in the order of what follows (suffix order), with their
   longest common prefixes. The previous and the next smaller position in that order give the longest previous factor of each, the
   previous and the next greater one the longest later factor.
3. An anchor whose segments pass BUCKET bytes isn't compared in one task: equal segments of it are copies whole, and one of each kind is
   split again by longer anchors, at last by whole windows, where equal anchors are equal windows.

With `words`, texts are compared in units of UNIT bytes: HELD bytes of a word and a mark whether it goes on, so that any passage of
that many words reaches as many units, whatever white space parts its words. Of what is found, passages of `words` words or of LENGTH bytes count.
Spans then go from the start of a word to the start of another; only words of LONG bytes or more are cut within.

Defined results: a null text counts as empty; texts shorter than the length have no windows; a null doc_id orders before all others; rows
that repeat both doc_id and text are copies of each other without keep_first, and are judged as one with it; texts that share a doc_id are
judged each on its own; of equal texts that with the least doc_id is the first; an empty table gives an empty table; overlapping matches
within one text count; texts of any length are looked at whole, in pieces that overlap by a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from lodestone.llm.common import TEXTS, cut, digest, discard, parallelism

LENGTH = 400
#: Bytes of a unit, where passages are measured in words, and bytes of a word in it.
UNIT, HELD = 8, 7
#: Words of so many bytes (of a text without spaces, say) can be cut.
LONG = 100
#: Bytes of an anchor's segments that one task compares at most.
BUCKET = 1 << 18
#: Bytes of segments whose suffixes are sorted together.
CHUNK = 1 << 20
#: Bytes of texts that are looked at together, and windows (fewer than 2^24, with a window's length).
SLICE = 1 << 19
PIECE = 1 << 20
#: Keys of texts that share half a digest, as far as they are sent to all tasks (none, but by design of the texts).
TWINS = 100_000

_RNG = np.random.default_rng(97)
_BYTES = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(0, 1 << 62)) * 4 + 3
_TABLE: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_NONE = np.zeros(0, dtype=np.int64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of the base and of its inverse, modulo 2^64."""
    if len(_TABLE["up"]) <= n:
        for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            _TABLE[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x % (1 << 64), np.uint64)]))
    return _TABLE["up"], _TABLE["down"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _symbols(raw: bytes, unit: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8 if unit == 1 else np.uint64)


def segments(x: np.ndarray, text: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of symbols and the numbers of their texts (-1: of none): the segments' starts, numbers of windows, places of anchors and anchor hashes.

    Equal anchors have equal hashes; that others may share one costs time and changes nothing.
    """
    windows = len(x) - length + 1
    if windows < 1:
        return _NONE, _NONE, _NONE, _NONE.astype(np.uint64)
    if windows > PIECE:  # a segment that passes a piece's end goes on as another
        parts = [(i, segments(x[i : i + PIECE + length - 1], text[i : i + PIECE + length - 1], length, anchor)) for i in range(0, windows, PIECE)]
        return tuple(np.concatenate([p[k] + i if k in (0, 2) else p[k] for i, p in parts]) for k in range(4))
    up, down = _powers(len(x))
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum((_BYTES[x] if x.dtype == np.uint8 else _mixed(x)) * up[: len(x)], out=sums[1:])
    full = _mixed((sums[anchor:] - sums[:-anchor]) * down[: len(x) - anchor + 1])
    low = np.uint64((1 << 24) - 1)
    least = (full & ~low) | np.arange(len(full), dtype=np.uint64)
    span, wanted = 1, length - anchor + 1
    while span * 2 <= wanted:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wanted:
        least = np.minimum(least[:windows], least[wanted - span :])
    at = (least & low).astype(np.int64)
    first = text[:windows]
    whole = (first == text[length - 1 :]) & (first >= 0)
    edge = ~whole[:-1] | ~whole[1:] | (at[1:] != at[:-1]) | (first[1:] != first[:-1])
    starts = np.flatnonzero(whole & np.concatenate([[True], edge]))
    n = np.flatnonzero(whole & np.concatenate([edge, [True]])) - starts + 1
    return starts, n, at[starts], full[at[starts]]


def word_table(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin, their bytes, and the places of all these bytes."""
    space = _SPACE[raw]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(raw) else _NONE
    ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1 if len(raw) else _NONE
    return begins, ends - begins, np.flatnonzero(~space)


def in_units(raw: bytes) -> bytes:
    """The words in units: HELD bytes and a plus while the word goes on, then what is left, filled up with spaces."""
    short = lambda w: w.ljust(UNIT)
    long = lambda w: b"".join([w[i : i + HELD] + b"+" for i in range(0, len(w) - HELD, HELD)]) + short(w[(len(w) - 1) // HELD * HELD :])
    return b"".join([short(w) if len(w) <= HELD else long(w) for w in raw.split()])


#: lo1, size1 and lo2, size2 are the bytes of the first and of the last start.
SEGMENT = "d long, t long, h long, c1 long, c2 long, k int, n int, starts array<int>, lo1 int, size1 int, lo2 int, size2 int, base1 int, base2 int"
TEXT = "d long, t long, base int, m int, data binary"


def _segment_rows(batches: Iterator[pa.RecordBatch], length: int, anchor: int, unit: int) -> Iterator[pa.RecordBatch]:
    """A row for each distinct segment of each text (TEXT: base, the place of its first symbol; m, how many symbols count, -1 for all), with all its
    starts, in order; k is the place of the anchor in it."""
    held: list[tuple[int, int, int, int, bytes]] = []
    size = 0
    for batch in batches:
        for *own, data in zip(*(batch.column(k).to_pylist() for k in ("d", "t", "base", "m")), batch.column("data"), strict=True):
            held.append((*own, data.as_buffer().to_pybytes() if data.is_valid else b""))
            size += len(held[-1][4])
            if size >= SLICE:
                yield from _sliced(held, length, anchor, unit)
                held, size = [], 0
    yield from _sliced(held, length, anchor, unit)


def _sliced(held: list[tuple[int, int, int, int, bytes]], length: int, anchor: int, unit: int) -> Iterator[pa.RecordBatch]:
    raw = b"\n".join(x[4] for x in held)
    data = np.frombuffer(raw, dtype=np.uint8)
    sizes = np.array([len(x[4]) for x in held], dtype=np.int64)
    lows = np.cumsum(sizes + 1) - sizes - 1  # where each text begins in raw
    kept = np.array([x[3] for x in held], dtype=np.int64)
    if unit == 1:
        x, count = data, sizes
        symbol_at, ends_at = np.arange(len(data)), np.arange(1, len(data) + 1)
        text = np.repeat(np.arange(len(held)), sizes + 1)[:-1]
        text[(lows + sizes)[:-1]] = -1  # the line feeds between texts
        first = lows
    else:
        begins, words, places = word_table(data)
        each = (words + HELD - 1) // HELD
        cells, word = np.cumsum(each) - each, np.repeat(np.arange(len(words)), words)
        filled = np.full(int(each.sum()) * UNIT, 32, dtype=np.uint8)
        step = places - begins[word]
        filled[(cells[word] + step // HELD) * UNIT + step % HELD] = data[places]
        own = np.repeat(np.arange(len(words)), each)
        step = np.arange(len(own)) - cells[own]
        filled[HELD::UNIT][step < each[own] - 1] = ord("+")
        x = filled.view(np.uint64)
        # A segment that ends within a word takes a byte more, so that its last unit is marked as going on.
        symbol_at, ends_at = begins[own] + step * HELD, begins[own] + np.minimum((step + 1) * HELD + 1, words[own])
        text = (np.searchsorted(lows, begins, "right") - 1)[own]
        count = np.bincount(text, minlength=len(held))
        first = np.cumsum(count) - count
    place = np.arange(len(x)) - first[text]
    text = np.where((kept[text] >= 0) & (place >= kept[text]), -1, text)
    starts, n, at, h = segments(x, text, length, anchor)
    if not len(starts):
        return
    view, of = memoryview(x.view(np.uint8)), text[starts]
    digests = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip((starts * unit).tolist(), ((starts + n + length - 1) * unit).tolist(), strict=True)])
    c1, c2 = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2).T
    order = np.lexsort((starts, c2, c1, of))
    differs = [y[order][1:] != y[order][:-1] for y in (of, c1, c2)]
    new = np.concatenate([[True], differs[0] | differs[1] | differs[2]])
    one, last = order[new], order[np.append(new[1:], True)]
    offsets = np.append(np.flatnonzero(new), len(order)).astype(np.int32)
    d, t, base = (np.array([y[k] for y in held], dtype=np.int64) for k in range(3))
    columns = [d[of[one]], t[of[one]], h[one].view(np.int64), c1[one], c2[one]] + [y.astype(np.int32) for y in ((at - starts)[one], n[one])]
    columns = [pa.array(y) for y in columns]
    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array((place[starts] + base[of])[order].astype(np.int32))))
    for i in (one, last):
        low, high = symbol_at[starts[i]], ends_at[starts[i] + n[i] + length - 2]
        columns += [pa.array((low - lows[of[i]]).astype(np.int32)), pa.array((high - low).astype(np.int32))]
    columns += [pa.array(base[of[i]].astype(np.int32)) for i in (one, last)]
    yield pa.RecordBatch.from_arrays(columns, names=[y.split()[0] for y in SEGMENT.split(", ")])


def _ordered(bucket: list[int], strings: list[bytes], sizes: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of strings in order of bucket and bytes, and the common prefix (in symbols) of each place with the one before; -1 across buckets."""
    order = sorted(range(len(strings)), key=list(zip(bucket, strings, strict=True)).__getitem__)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    width = max(1, int(sizes.max()))
    rows = _symbols(b"".join([strings[i].ljust(width * unit, b"\0") for i in order]), unit).reshape(-1, width)
    unlike = rows[1:] != rows[:-1]
    common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
    size, group = sizes[order], np.array(bucket)[order]
    common = np.minimum(common, np.minimum(size[1:], size[:-1]))
    return place, np.concatenate([[-1], np.where(group[1:] == group[:-1], common, -1)])


def _least_between(x: np.ndarray) -> list[np.ndarray]:
    """Minima of stretches of 1, 2, 4 ... numbers."""
    out = [x]
    while len(out[-1]) > (step := 1 << (len(out) - 1)):
        out.append(np.minimum(out[-1][:-step], out[-1][step:]))
    return out


def _least(tables: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number from place a to place b, both counted."""
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), dtype=np.int64)
    for k in np.unique(level):
        own = level == k
        out[own] = np.minimum(tables[k][a[own]], tables[k][b[own] - (1 << int(k)) + 1])
    return out


def _smaller(value: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it in its group with a smaller value, or -1. No two values are equal."""
    near = np.arange(len(value)) - 1
    near[np.concatenate([[True], group[1:] != group[:-1]])] = -1
    todo = np.flatnonzero(near >= 0)
    while len(todo := todo[value[near[todo]] > value[todo]]):
        near[todo] = near[near[todo]]
        todo = todo[near[todo] >= 0]
    return near


def factors(bucket: list[int], k: np.ndarray, n: np.ndarray, place: np.ndarray, data: list[bytes], length: int, unit: int, keep_first: bool) -> tuple[np.ndarray, ...]:
    """Of segments side by side (bucket, place of the anchor, number of windows, place in the order of texts, bytes): the windows, as segment and
    number, whose longest previous factor (or longest factor elsewhere) may reach the length, with that factor, as far as it is compared."""
    before = [b"".join([x[i * unit - unit : i * unit] for i in range(a, 0, -1)]) if unit > 1 else x[:a][::-1] for x, a in zip(data, k.tolist(), strict=True)]
    after = [x[a * unit :] for x, a in zip(data, k.tolist(), strict=True)]
    left, common_left = _ordered(bucket, before, k, unit)
    right, common_right = _ordered(bucket, after, np.array([len(x) // unit for x in after]), unit)
    best = lambda at, common: np.maximum(common[at], np.append(common, -1)[at + 1])
    # A window begins b symbols before the anchor; both sides must have a partner, each on its own, for there to be one of the whole.
    low, high = np.maximum(k - n + 1, length - best(right, common_right)), np.minimum(k, best(left, common_left))
    count = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(k)), count)
    b = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]
    if not len(row):
        return row, b, row
    # Rows that share the b symbols before the anchor: those from the last place in left order whose common prefix is shorter.
    depth = int(b.max()) + 1
    shared = np.maximum.accumulate(np.where(common_left[:, None] < np.arange(depth)[None, :], np.arange(len(k))[:, None], 0), axis=0)[left[row], b]
    group = b * len(k) + shared
    order = np.lexsort((right[row], group))  # suffix order
    row, b, group = row[order], b[order], group[order]
    at, tables = right[row], _least_between(common_right)
    out = np.zeros(len(row), dtype=np.int64)

    def raised(own: np.ndarray, other: np.ndarray) -> None:
        a, z = np.minimum(at[own], at[other]), np.maximum(at[own], at[other])
        out[own] = np.maximum(out[own], b[own] + _least(tables, a + 1, z))

    # The previous and the next smaller position in suffix order give the longest previous factor; in the order from the last text to the first, the longest later one.
    last = len(row) - 1
    for value in [place[row]] if keep_first else [place[row], -place[row]]:
        own = np.flatnonzero((prev := _smaller(value, group)) >= 0)
        raised(own, prev[own])
        own = np.flatnonzero((prev := _smaller(value[::-1], group[::-1])[::-1]) >= 0)
        raised(own, last - prev[own])
    return row, k[row] - b, out


COMPARED = "h long, c1 long, c2 long, later boolean, d long, t long, pos int, fd long, ft long, fpos int, k int, n int, data binary"
RUNS = "h long, c1 long, c2 long, later boolean, d long, t long, pos int, fd long, ft long, fpos int, a int, b int"
_CARRIED = ["h", "c1", "c2", "later", "d", "t", "pos", "fd", "ft", "fpos"]


def _runs(rows: pd.DataFrame, length: int, unit: int, keep_first: bool) -> pd.DataFrame:
    """Runs (a, b: the first and last window) of copied windows of segments in whole buckets."""
    data = rows["data"].tolist()
    if unit > 1:
        data = [in_units(x)[: (n + length - 1) * unit] for x, n in zip(data, rows["n"].tolist(), strict=True)]
    place = np.empty(len(rows), dtype=np.int64)
    place[np.lexsort((rows["later"], rows["pos"], rows["t"], rows["d"]))] = np.arange(len(rows))
    row, window, factor = factors(rows["h"].tolist(), rows["k"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), place, data, length, unit, keep_first)
    hit = factor >= length
    row, window = row[hit], window[hit]
    order = np.lexsort((window, row))
    row, window = row[order], window[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)]) if len(row) else np.zeros(0, bool)
    first, last = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True)) if len(row) else _NONE
    return rows[_CARRIED].iloc[row[first]].assign(a=window[first].astype(np.int32), b=window[last].astype(np.int32))


def _compare(batches: Iterator[pd.DataFrame], length: int, unit: int, keep_first: bool) -> Iterator[pd.DataFrame]:
    """Runs of rows (COMPARED) in order of h, a chunk of whole buckets at a time."""
    held, size = [], 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        size += int(pdf["data"].map(len).sum())
        if size >= CHUNK:
            rows = pd.concat(held)
            last = rows["h"].to_numpy() == rows["h"].iloc[-1]
            if not last.all():
                yield _runs(rows[~last], length, unit, keep_first)
                held = [rows[last]]
                size = int(held[0]["data"].map(len).sum())
    if held:
        yield _runs(pd.concat(held), length, unit, keep_first)


def _anchors(length: int) -> list[int]:
    return [max(1, length // 4), max(1, length * 5 // 8), max(1, length - length // 16), length]


class Measure:
    """Windows of so many symbols, and what is known of their segments at a level: rows, kinds and the members that are wanted with their bytes."""

    def __init__(self, length: int, unit: int, level: int = 0) -> None:
        self.length, self.unit, self.level, self.written = length, unit, level, []

    def segment(self, texts: DataFrame, keep_first: bool) -> DataFrame:
        """The wanted members (_d, _t, _x) of texts (TEXT)."""
        length, unit, anchor = self.length, self.unit, _anchors(self.length)[self.level]
        every = cut(texts.mapInArrow(lambda b: _segment_rows(b, length, anchor, unit), SEGMENT), f"segments-{self.level}", batch=TEXTS, release=True)
        repeated = every.groupBy(F.col("h").alias("_h")).agg(F.sum(F.size("starts")).alias("_n")).filter("_n > 1").select("_h")
        self.rows = cut(every.join(repeated, F.col("h") == F.col("_h"), "left_semi"), f"repeated-{self.level}", release=True)
        discard(every)
        place = lambda i, k: F.struct("d", "t", F.element_at("starts", i).alias("pos"), F.col(f"lo{k}").alias("lo"), F.col(f"size{k}").alias("size"), F.col(f"base{k}").alias("own"))
        kinds = self.rows.groupBy("h", "c1", "c2", "k", "n").agg(F.sum(F.size("starts")).alias("_copies"), F.min(place(1, 1)).alias("_first"), F.max(place(-1, 2)).alias("_last"))
        two = (F.struct("_first.d", "_first.t", "_first.pos") != F.struct("_last.d", "_last.t", "_last.pos")) if keep_first else F.col("_copies") > 1
        kinds = kinds.select("h", "c1", "c2", "k", "n", two.alias("_two"), "_first", "_last")
        sizes = kinds.groupBy(F.col("h").alias("_h")).agg(F.sum((F.col("n") + length - 1) * unit * (1 + F.col("_two").cast("long"))).alias("_bytes"), F.count("*").alias("_kinds"))
        # A bucket that holds one segment once (of a repeated row) has nothing to compare.
        kinds = kinds.join(sizes, F.col("h") == F.col("_h")).drop("_h").filter("_two OR _kinds > 1")
        large = F.col("_bytes") > (BUCKET if self.level + 1 < len(_anchors(length)) else 1 << 62)
        self.kinds = cut(kinds.withColumn("large", large).drop("_bytes", "_kinds"), f"kinds-{self.level}", release=True)
        # The last of a kind that stands twice at one place (in repeated rows) is that place again.
        members = self.kinds.select("*", F.posexplode(F.when(F.col("_two") & ~F.col("large"), F.array("_first", "_last")).otherwise(F.array("_first"))).alias("_i", "_own"))
        first = [F.col(f"_first.{a}").alias(b) for a, b in (("d", "fd"), ("t", "ft"), ("pos", "fpos"))]
        member = F.struct("h", "c1", "c2", (F.col("_i") > 0).alias("later"), F.col("_own.pos").alias("pos"), *first, "k", "n", "large", F.col("_own.lo").alias("lo"), F.col("_own.size").alias("size"), F.col("_own.own").alias("own"))
        return members.select(F.col("_own.d").alias("_d"), F.col("_own.t").alias("_t"), member.alias("_x"))

    def compare(self, got: DataFrame, keep_first: bool) -> DataFrame:
        """Runs (d, t, a, b: first and last window) of copied windows, from the members with their bytes (COMPARED and large)."""
        length, unit = self.length, self.unit
        names = [x.split()[0] for x in COMPARED.split(", ")]
        spread = got.filter("NOT large").select(*names).repartition(parallelism(got.sparkSession), "h").sortWithinPartitions("h", "d", "t", "pos")
        found = cut(spread.mapInPandas(lambda b: _compare(b, length, unit, keep_first), RUNS), f"runs-{self.level}", release=True)
        self.written = [self.rows, self.kinds, found]
        out = found.filter("NOT later").select("d", "t", (F.col("pos") + F.col("a")).alias("a"), (F.col("pos") + F.col("b")).alias("b"))
        # What holds of a kind's last segment holds of all but its first; in a bucket that isn't compared, such a segment is a copy whole.
        whole = self.kinds.filter("large AND _two").select("h", "c1", "c2", F.col("_first.d").alias("fd"), F.col("_first.t").alias("ft"), F.col("_first.pos").alias("fpos"), F.lit(0).alias("a"), (F.col("n") - 1).alias("b"))
        of_kind = found.filter("later").select("h", "c1", "c2", "fd", "ft", "fpos", "a", "b").unionByName(whole).withColumnsRenamed({"h": "_h", "c1": "_c1", "c2": "_c2", "a": "_a", "b": "_b"})
        more = self.rows.join(of_kind, (F.col("h") == F.col("_h")) & (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2")))
        more = more.select("d", "t", "fd", "ft", "fpos", "_a", "_b", F.explode("starts").alias("pos"))
        if keep_first:
            more = more.filter(~((F.col("d") == F.col("fd")) & (F.col("t") == F.col("ft")) & (F.col("pos") == F.col("fpos"))))
        out = out.unionByName(more.select("d", "t", (F.col("pos") + F.col("_a")).alias("a"), (F.col("pos") + F.col("_b")).alias("b")))
        if self.level + 1 == len(_anchors(length)):
            return out
        rest = got.filter("large").select("d", "t", F.col("pos").alias("base"), (F.col("n") + length - 1).alias("m"), "data")
        if rest.isEmpty():
            return out
        deeper = Measure(length, unit, self.level + 1)
        more = _fetched(rest, deeper.segment(rest, keep_first).withColumn("i", F.lit(0)), f"compared-{deeper.level}")
        out = out.unionByName(deeper.compare(more, keep_first))
        self.written += [more, *deeper.written]
        return out


def _fetched(source: DataFrame, wanted: DataFrame, label: str) -> DataFrame:
    """wanted (_d, _t, i, _x) with the bytes of their segments; of several pieces of a text, that in which the segment was found."""
    got = source.join(wanted, (F.col("d") == F.col("_d")) & (F.col("t") == F.col("_t")))
    return cut(got.filter(F.col("_x.own") == F.col("base")).select("i", "d", "t", F.substring("data", F.col("_x.lo") + 1, F.col("_x.size")).alias("data"), "_x.*"), label, release=True)


def copies(texts: DataFrame, measures: list[tuple[int, int]], keep_first: bool) -> list[DataFrame]:
    """Runs (d, t, a, b: first and last window) of copied windows of texts (TEXT), a table for each measure (length, unit). They are made one after another: the tables of one are
    gone when the next begins."""
    out = []
    for x in reversed(measures):  # what is reported has more segments: it goes first, so that nothing else lies beside it
        found = Measure(*x)
        got = _fetched(texts.dropDuplicates(["d", "t"]), found.segment(texts, keep_first).withColumn("i", F.lit(0)), "compared-0")
        out.append(cut(found.compare(got, keep_first), "copies", release=True))
        discard(got, *found.written)
    return out[::-1]


def _union(a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Of runs of windows from a to b: the maximal stretches that these cover, as rows (from, to)."""
    if not len(a):
        return np.zeros((0, 2), dtype=np.int64)
    order = np.argsort(a, kind="stable")
    a, reach = a[order].astype(np.int64), np.maximum.accumulate(b[order].astype(np.int64) + length)
    new = np.concatenate([[True], a[1:] > reach[:-1]])
    return np.stack([a[new], reach[np.append(new[1:], True)]], axis=1)


def _in_text(raw: bytes, spans: np.ndarray, words: int) -> np.ndarray:
    """Spans of units as spans of raw: of whole words and the spaces after them, and of parts of words of LONG bytes."""
    if not len(spans):
        return spans
    begins, sizes, _ = word_table(np.frombuffer(raw, dtype=np.uint8))
    ends = np.cumsum((sizes + HELD - 1) // HELD)
    cells = ends - (sizes + HELD - 1) // HELD
    after = np.append(begins[1:], len(raw))
    a, b = spans[:, 0], spans[:, 1]
    first, last = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left")  # the words in which spans begin and end
    at = (a - cells[first]) * HELD
    low = np.where(at == 0, begins[first], np.where(sizes[first] >= LONG, begins[first] + np.minimum(at, sizes[first]), after[first]))
    at = (b - cells[last]) * HELD
    high = np.where(b == ends[last], after[last], np.where(sizes[last] >= LONG, begins[last] + np.minimum(at, sizes[last]), begins[last]))
    n = np.searchsorted(begins, high, "left") - np.searchsorted(begins, low, "left")
    return np.stack([low, high], axis=1)[(n >= words) | (high - low >= LENGTH)]


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bounds of each row's list (null: empty), and both fields of all elements."""
    flat = column.flatten()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]), *(flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))


def _lists(spans: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*spans, np.zeros((0, 2), dtype=np.int64)])
    fields = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["from", "to"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, spans)]).astype(np.int32)), fields)


def _halves(text: Column) -> list[Column]:
    return [F.conv(F.hex(F.substring(digest(text), at, 8)), 16, -10).cast("long") for at in (1, 9)]


def keyed_texts(docs: DataFrame, row: Column) -> DataFrame:
    """_row, _text, _d (the doc_id; the least long for a null) and _t, which tell texts apart: _t is negative where there is no doc_id, and has 63 bits of the
    text's digest. Texts of one doc_id that agree in these are told by 63 other bits, so that all but the sign of 128 bits must agree to take two for one."""
    text, doc_id = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    signed = [F.when(doc_id.isNull(), x.bitwiseOR(F.lit(-(2**63)))).otherwise(x.bitwiseAND(F.lit(2**63 - 1))) for x in _halves(text)]
    own_d = F.coalesce(doc_id, F.lit(-(2**63)))
    own = docs.select(own_d.alias("_d"), signed[0].alias("_t"), digest(text).alias("x")).groupBy("_d", "_t").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    twins = cut(own.filter("a != b").select(F.col("_d").alias("_d2"), F.col("_t").alias("_t2")), "twins")
    df = docs.select(row.alias("_row"), text.alias("_text"), own_d.alias("_d"), signed[0].alias("_t"), signed[1].alias("_other"))
    if (n := twins.count()) == 0:
        return df.drop("_other")
    df = df.join(F.broadcast(twins) if n <= TWINS else twins, (F.col("_d") == F.col("_d2")) & (F.col("_t") == F.col("_t2")), "left")
    return df.select("_row", "_text", "_d", F.when(F.col("_t2").isNotNull(), F.col("_other")).otherwise(F.col("_t")).alias("_t"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, words: int = 0, report: int = 0, keep: list[str] | None = None) -> DataFrame:
    """keep (all columns) with _bytes (of the text), _spans (the stretches removed: from, to, in bytes), _rest (the bytes that are left),
    _rest_text, these as text without the parts of characters that a span has cut through, and _passages. Columns of these names are replaced.

    With words, passages of that many words are looked for, and length isn't used. With report, passages of that many words
    are looked for too, and stand in _passages (from, to), but stay in the text.
    """
    own = [c for c in keep or docs.columns if c not in ("_bytes", "_spans", "_rest", "_rest_text", "_passages")]
    keyed = keyed_texts(docs, F.struct(*own))
    texts = keyed.select(F.col("_d").alias("d"), F.col("_t").alias("t"), F.lit(0).alias("base"), F.lit(-1).alias("m"), F.col("_text").cast("binary").alias("data"))
    tables = copies(texts, [(words, UNIT) if words else (length, 1), *[(report, UNIT)] * bool(report)], keep_first)
    found = reduce(DataFrame.unionByName, [x.withColumn("i", F.lit(i)) for i, x in enumerate(tables)])
    runs = cut(found.groupBy("d", "t").agg(*[F.collect_set(F.when(F.col("i") == i, F.struct("a", "b"))).alias(f"_runs{i}") for i in (0, 1)]), "runs", release=True)
    discard(*tables)
    df = keyed.join(runs, (F.col("_d") == F.col("d")) & (F.col("_t") == F.col("t")), "left")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                part = batch.slice(begin, TEXTS)
                texts, (at0, a0, b0), (at1, a1, b1) = part.column("_text").to_pylist(), _pairs(part.column("_runs0")), _pairs(part.column("_runs1"))
                sizes, removed, rests, lefts, told = [], [], [], [], []
                for i, x in enumerate(texts):
                    raw = x.encode()
                    own, other = slice(at0[i], at0[i + 1]), slice(at1[i], at1[i + 1])
                    spans = _union(a0[own], b0[own], words or length)
                    spans = _in_text(raw, spans, words) if words else spans
                    edges = [0, *spans.ravel().tolist(), len(raw)]
                    rest = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]) if len(spans) else raw
                    sizes.append(len(raw))
                    removed.append(spans)
                    rests.append(rest)
                    lefts.append(rest.decode(errors="ignore") if len(spans) else x)
                    told.append(_in_text(raw, _union(a1[other], b1[other], report), report))
                columns = [part.column("_row"), pa.array(sizes, pa.int64()), _lists(removed), pa.array(rests, pa.binary()), pa.array(lefts, pa.string()), _lists(told)]
                yield pa.RecordBatch.from_arrays(columns, names=["_row", *names])

    names = ["_bytes", "_spans", "_rest", "_rest_text", "_passages"]
    spans = ArrayType(StructType([StructField("from", LongType()), StructField("to", LongType())]))
    types = zip(names, (LongType(), spans, BinaryType(), StringType(), spans), strict=True)
    df = df.select("_row", "_text", "_runs0", "_runs1")
    df = df.mapInArrow(strip, StructType([df.schema["_row"], *(StructField(k, t) for k, t in types)]))
    return df.select("_row.*", *names)
