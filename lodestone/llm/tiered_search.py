"""Ranked lexical search over a tiered index, with results proved exact.

The index is a table of shards: each holds some documents of one task, the postings of all their terms, and these in tiers by impact. The impact of a
posting is its term's weight times what the occurrences add; for its tier a shard takes the weight that the term would have by the shard's own counts, so that an index needs no
shuffle. Tier 0 holds the postings of at least LEVELS[0] of the greatest possible impact, the next tiers lower ones, the last the rest. A tier is a few columns, so a search
that stops early never reads the lower ones. For each term and tier a shard keeps the most that an occurrence adds in any lower tier: over all shards, and times the term's true weight,
that is its residual bound. Bounds and scores are exact; the levels, and the shard's own weights, decide only how early an item ends.

Round k searches the open items in tiers 0 to k:
1. The best documents by what these tiers hold are completed from the lower tiers of their shards. Their k-th score bounds an item's k-th score from below.
2. A document that none of the tiers shows scores at most the sum of the item's residual bounds. Where that is below the bound, the item is proved: only
   documents whose known part and residual bounds reach it can be in the result; these are completed and ranked. An item without residuals is complete as it is.
3. Items that aren't proved fall through to the next round, and one tier lower. The last tier leaves no residuals, so every item ends.

A document is a row and lies in one shard; items are searched in blocks of ITEM_BLOCK. Every number but the logarithm is a whole number.

Defined results: a null text holds no terms, and texts without terms count for nothing; rows without a doc_id are documents and come after all others of equal
score; rows that share a doc_id, or repeat, are documents each; a null item_id is an item, rows that share an item_id are items each; items without a known term, and empty tables, give no rows; only
doc_id, item_id and text are looked at, whatever other columns are called. Texts are read whole; a shard ends with the document in which it reaches SHARD_TERMS terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import TEXTS, cut, discard

TOP = 10
#: Parts of the greatest possible impact (of a term that stands once) at which tiers end.
LEVELS = (1 / 4, 1 / 12)
#: Terms in which a shard's last document begins, and documents of a shard, at most.
SHARD_TERMS, SHARD_DOCS = 500_000, 4096
#: Items of a block, and their distinct terms, about.
ITEM_BLOCK, BLOCK_TERMS = 1024, 200_000
#: Documents of an item that are completed to get its bound from below.
TRIED = 30
#: Candidates that are sent to every shard at most; more of them are joined to their shards by a shuffle.
SENT = 200_000
SHARDS_AT_ONCE = 4
#: Fixed values of the ranking: what occurrences add is SCALE * tf div (1000 * tf + 8 * m), m = 100 - SLOPE + (SLOPE * n * N) div L.
SCALE, SLOPE = 1_000_000_000, 75
#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased.
_AS_TERMS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_AS_TERMS).split()


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


#: A document has a row (its number), an id (0 if it has none) and known (whether it has one); its place is where it stands in these lists.
DOCS = "row array<long>, id array<long>, known array<boolean>"
#: A tier: its terms side by side, where each one's postings end, and these: places of documents, and what the occurrences add.
_TIER = {"term": "string", "ends": "array<int>", "doc": "array<int>", "adds": "array<int>"}


def _columns(tiers: Iterable[int]) -> list[str]:
    return [f"{c}{k}" for k in tiers for c in _TIER]


def _schema(n_tiers: int) -> str:
    """Besides tiers a shard has all its terms (term, side by side), in how many of its documents each stands, and the most that any lower tier than each adds."""
    tiers = [f"{c}{k} {t}" for k in range(n_tiers) for c, t in _TIER.items()]
    return ", ".join([f"shard long, n_docs long, {DOCS}", *tiers, "term string, df array<int>", *(f"below{k} array<int>" for k in range(n_tiers - 1))])


def _shards(batches: Iterator[pd.DataFrame], n_docs: int, n_terms: int, levels: tuple[float, ...]) -> Iterator[pd.DataFrame]:
    """Documents (row, id, known, text) as shards of tiers."""
    numbers: dict[bytes, int] = {}
    rows, own, count, total = [], [], [], 0  # rows: row, id, known, n

    def shard() -> pd.DataFrame:
        words = sorted(numbers)
        place = np.empty(len(words), dtype=np.int64)
        place[[numbers[w] for w in words]] = np.arange(len(words))
        term, doc, tf = place[np.concatenate(own)], np.repeat(np.arange(len(rows)), [len(x) for x in own]), np.concatenate(count)
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        row, ids, known, n = (np.array(x) for x in zip(*rows, strict=True))
        m = 100 - SLOPE + (SLOPE * n.astype(np.int64) * n_docs) // n_terms
        adds = (SCALE * tf) // (1000 * tf + 8 * m[doc])
        df = np.bincount(term, minlength=len(words))
        impact = np.log((2.0 * len(rows) + 2) / (2 * df + 1))[term] * adds
        greatest = 1e6 * math.log((2.0 * len(rows) + 2) / 3)
        tier = np.zeros(len(term), dtype=np.int64)
        for x in levels:
            tier += impact < x * greatest
        word, most = np.array([w.decode() for w in words], dtype=object), np.zeros((len(words), len(levels) + 2), dtype=np.int64)
        out = {"shard": int(row[0]), "n_docs": n_docs, "row": row.astype(np.int64), "id": ids.astype(np.int64), "known": known.astype(bool)}
        for k in range(len(levels) + 1):
            at = np.flatnonzero(tier == k)
            there, first = np.unique(term[at], return_index=True)
            out |= dict(zip(_columns([k]), [" ".join(word[there]), np.append(first[1:], len(at))[: len(there)].astype(np.int32), doc[at].astype(np.int32), adds[at].astype(np.int32)], strict=True))
            if len(at):
                most[there, k] = np.maximum.reduceat(adds[at], first)
        below = np.maximum.accumulate(most[:, ::-1], axis=1)[:, ::-1][:, 1:]
        return pd.DataFrame([out | {"term": " ".join(word), "df": df.astype(np.int32)} | {f"below{k}": below[:, k].astype(np.int32) for k in range(len(levels))}])

    for pdf in batches:
        for row, own_id, known, text in zip(*(pdf[c].tolist() for c in ("row", "id", "known", "text")), strict=True):
            words = terms(text)
            if not words:
                continue
            counts = Counter(words)
            own.append(np.array([numbers.setdefault(w, len(numbers)) for w in counts], dtype=np.int64))
            count.append(np.fromiter(counts.values(), dtype=np.int64, count=len(counts)))
            rows.append((row, own_id, known, len(words)))
            total += len(words)
            if total >= SHARD_TERMS or len(rows) >= SHARD_DOCS:
                yield shard()
                numbers, rows, own, count, total = {}, [], [], [], 0
    if rows:
        yield shard()


def tiered_index(docs: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """The shards of docs: two passes over the texts, the first of which counts documents and terms."""
    size = F.pandas_udf(lambda texts: pd.Series([len(terms(x)) for x in texts], dtype="int64"), "long")
    sizes = cut(docs.select(size("text").alias("n")).filter("n > 0"), "text-sizes", batch=TEXTS)
    n_docs, n_terms = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    discard(sizes)
    own = F.col("doc_id").cast("long")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(own, F.lit(0)).alias("id"), own.isNotNull().alias("known"), "text")
    return cut(numbered.mapInPandas(lambda b: _shards(b, n_docs, n_terms, levels), _schema(len(levels) + 1)), "tiers", batch=TEXTS)


def bounds(shards: DataFrame, terms: DataFrame, n_tiers: int) -> DataFrame:
    """Of terms (term) that the index knows: term, weight, and the residual bounds below each tier."""
    below = [f"below{k}" for k in range(n_tiers - 1)]
    every = shards.select("n_docs", F.explode(F.arrays_zip(F.split("term", " ").alias("term"), "df", *below)).alias("x")).select("n_docs", "x.*")
    found = every.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.max("n_docs").alias("n"), F.sum("df").alias("df"), *[F.max(c).cast("long").alias(c) for c in below])
    found = found.withColumn("weight", F.floor(1000 * F.log((F.lit(2.0) * F.col("n") + 2) / (2 * F.col("df") + 1))))
    return found.select("term", "weight", F.array(*[F.col("weight") * F.col(c) for c in below], F.lit(0).cast("long")).alias("residuals"))


class Asked:
    """A block's items by their places: what each asks for, and what tiers below k can add to it at most."""

    def __init__(self, rows: list, n_tiers: int) -> None:
        self.by_item: dict[int, list[tuple[str, int]]] = {}
        self.by_term: dict[str, list[tuple[int, int]]] = {}
        self.residual: dict[str, list[int]] = {}
        self.weight: dict[str, int] = {}
        self.rest: dict[int, list[int]] = {}
        for r in rows:
            self.by_item.setdefault(r["i"], []).append((r["term"], r["times"]))
            self.by_term.setdefault(r["term"], []).append((r["i"], r["times"]))
            self.residual[r["term"]], self.weight[r["term"]] = list(r["residuals"]), r["weight"]
            self.rest[r["i"]] = [a + r["times"] * b for a, b in zip(self.rest.get(r["i"], [0] * n_tiers), r["residuals"], strict=True)]


FOUND = "i int, shard long, place int, row long, id long, known boolean, score long"
#: The better of two documents comes first.
BETTER = ["score", "known", "id", "row"]


def _known_part(row, tiers: int, asked: Asked, items: np.ndarray, with_rest: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Items (some of a block) x documents of a shard: what tiers 0 to tiers hold, and what lower ones may add to a document that these show."""
    slot = {int(i): k for k, i in enumerate(items)}
    total = np.zeros((len(items), len(row.row)), dtype=np.int64)
    rest = np.repeat(np.array([asked.rest[int(i)][tiers] for i in items], dtype=np.int64)[:, None], total.shape[1], axis=1) if with_rest else None
    asking = {t: pairs for t, every in asked.by_term.items() if (pairs := [(slot[i], n) for i, n in every if i in slot])}
    for k in range(tiers + 1):
        term, ends, doc, adds = (getattr(row, c) for c in _columns([k]))
        for j, t in enumerate(term.split(" ") if term else ()):
            if (pairs := asking.get(t)) is not None:
                own = slice(ends[j - 1] if j else 0, ends[j])
                at, times = np.array(pairs, dtype=np.int64).T
                cells = (at[:, None], doc[own][None, :])
                total[cells] += times[:, None] * (asked.weight[t] * adds[own].astype(np.int64))[None, :]
                if rest is not None:
                    rest[cells] -= times[:, None] * asked.residual[t][tiers]
    return total, rest


def _rows(row, i: int, place: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"i": np.full(len(place), i, dtype=np.int32), "shard": row.shard, "place": place.astype(np.int32), "row": row.row[place], "id": row.id[place], "known": row.known[place], "score": score})


def _best(batches: Iterator[pd.DataFrame], tiers: int, asked: Broadcast, items: np.ndarray, top: int) -> Iterator[pd.DataFrame]:
    """Of all shards of a task the items' top documents by their known part."""
    first = lambda df: df.sort_values(["i", *BETTER], ascending=[True, False, False, True, True]).groupby("i").head(top)
    held: list[pd.DataFrame] = []
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            total, _ = _known_part(row, tiers, asked.value, items, False)
            place = np.empty(len(row.row), dtype=np.int64)
            place[np.lexsort((row.row, row.id, ~row.known))] = np.arange(len(place))
            for k, i in enumerate(items):
                at = np.flatnonzero(total[k] > 0)
                if len(at) > top:
                    at = at[total[k][at] >= np.partition(total[k][at], len(at) - top)[len(at) - top]]
                    at = at[np.lexsort((place[at], -total[k][at]))][:top]
                if len(at):
                    held.append(_rows(row, int(i), at, total[k][at]))
        if held:
            held = [first(pd.concat(held))]
    yield from held


def _reaching(batches: Iterator[pd.DataFrame], tiers: int, asked: Broadcast, floors: dict[int, int]) -> Iterator[pd.DataFrame]:
    """The documents whose known part and residual bounds together reach their item's floor."""
    items = np.array(sorted(floors))
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            total, rest = _known_part(row, tiers, asked.value, items, True)
            parts = [_rows(row, int(i), at, total[k][at]) for k, i in enumerate(items) if len(at := np.flatnonzero((total[k] > 0) & (total[k] + rest[k] >= floors[int(i)])))]
            if parts:
                yield pd.concat(parts)


def _completed(batches: Iterator[pd.DataFrame], tiers: list[int], asked: Broadcast) -> Iterator[pd.DataFrame]:
    """Documents (found: struct of FOUND) of a shard with what its lower tiers add."""
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            found = pd.DataFrame(list(row.found)).sort_values(["i", "place"])
            place, score, who = (found[c].to_numpy(np.int64) for c in ("place", "score", "i"))
            edges = np.flatnonzero(np.concatenate([[True], np.diff(who) != 0, [True]]))
            for k in tiers:
                term, ends, doc, adds = (getattr(row, c) for c in _columns([k]))
                number = {t: j for j, t in enumerate(term.split(" ")) if t in asked.value.by_term}
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    for t, times in asked.value.by_item[int(who[a])]:
                        if (j := number.get(t)) is not None:
                            own = slice(ends[j - 1] if j else 0, ends[j])
                            at = np.minimum(np.searchsorted(doc[own], place[a:b]), ends[j] - own.start - 1)
                            score[a:b] += np.where(doc[own][at] == place[a:b], times * asked.value.weight[t] * adds[own][at].astype(np.int64), 0)
            yield found.assign(score=score)[_names(FOUND)].astype({"i": "int32", "place": "int32"})


class Search:
    """The searches of one block of items."""

    def __init__(self, shards: DataFrame, n_tiers: int, rows: list, top: int) -> None:
        self.shards, self.n_tiers, self.top, self.own = shards, n_tiers, top, Asked(rows, n_tiers)
        self.asked = shards.sparkSession.sparkContext.broadcast(self.own)
        self.ended: list[int] = []  # items by the round in which they ended

    def _scan(self, tiers: int) -> DataFrame:
        return self.shards.select("shard", *_names(DOCS), *_columns(range(tiers + 1)))

    def _first(self, found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("i").orderBy(F.desc("score"), F.desc("known"), "id", "row")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def _complete(self, found: DataFrame, tiers: int) -> DataFrame:
        lower = list(range(tiers + 1, self.n_tiers))
        by_shard = found.groupBy(F.col("shard").alias("_s")).agg(F.collect_list(F.struct(*_names(FOUND))).alias("found"))  # a shard's documents, once an item
        by_shard = F.broadcast(by_shard) if found.count() <= SENT else by_shard
        df = self.shards.select("shard", *_columns(lower)).join(by_shard, F.col("shard") == F.col("_s")).drop("_s")
        return cut(df.mapInPandas(lambda b, asked=self.asked: _completed(b, lower, asked), FOUND), "completed", batch=SHARDS_AT_ONCE)

    def run(self) -> list[DataFrame]:
        """i, rank, id, known and score, in parts; each item is in one of them, if it finds anything."""
        open_items, out = np.array(sorted(self.own.by_item)), []
        for k in range(self.n_tiers):
            last, asked, items = k + 1 == self.n_tiers, self.asked, open_items
            near = self._scan(k).mapInPandas(lambda b, k=k, asked=asked, items=items, n=max(self.top, TRIED): _best(b, k, asked, items, n), FOUND)
            near = cut(near, "near", batch=SHARDS_AT_ONCE)
            if last:
                out.append(self._first(near, self.top))
                self.ended += [k] * len(items)
                break
            tried = self._complete(cut(self._first(near, max(self.top, TRIED)).drop("rank"), "tried"), k)
            kth = {r["i"]: r["score"] for r in self._first(tried, self.top).filter(F.col("rank") == self.top).collect()}  # a row an item of the block
            rest = {int(i): self.own.rest[int(i)][k] for i in items}
            whole = [i for i, x in rest.items() if x == 0]
            proved = {i: kth[i] for i, x in rest.items() if x > 0 and kth.get(i, 0) > x}
            if whole:
                out.append(self._first(near.filter(F.col("i").isin(whole)), self.top))
            if proved:
                found = cut(self._scan(k).mapInPandas(lambda b, k=k, asked=asked, floors=proved: _reaching(b, k, asked, floors), FOUND), "reaching", batch=SHARDS_AT_ONCE)
                out.append(self._first(self._complete(found, k), self.top))
            self.ended += [k] * (len(whole) + len(proved))
            open_items = np.array([i for i in items if int(i) not in proved and rest[int(i)] > 0])
            if not len(open_items):
                break
        return out


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """item_id, rank, doc_id and score: the top documents of each item."""
    shards = tiered_index(docs, levels)
    out = search(shards, items, top, len(levels) + 1)
    discard(shards)
    return out


def search(shards: DataFrame, items: DataFrame, top: int, n_tiers: int) -> DataFrame:
    spark = shards.sparkSession
    words = F.pandas_udf(lambda xs: pd.Series([[w.decode() for w in terms(x)] for x in xs]), "array<string>")
    asked = cut(items.select(F.monotonically_increasing_id().alias("item"), "item_id", words("text").alias("words")), "items", batch=TEXTS)
    counted = asked.select("item", F.explode("words").alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))
    counted = cut(counted.join(bounds(shards, counted, n_tiers), "term"), "item-terms")
    n_items, n_pairs = asked.count(), counted.count()
    n_blocks = max(1, -(-n_items // ITEM_BLOCK), -(-n_pairs // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("item"), F.lit(n_blocks))
    placed = asked.select("item", "item_id", block.alias("block"), (F.row_number().over(Window.partitionBy(block).orderBy("item")) - 1).alias("i"))
    placed = cut(placed, "items-placed")
    counted = counted.join(placed, "item")
    out = []
    for b in range(n_blocks):
        rows = counted.filter(F.col("block") == b).select("i", "term", "times", "weight", "residuals").collect()  # the items of one block
        for part in Search(shards, n_tiers, rows, top).run() if rows else []:
            out.append(part.join(placed.filter(F.col("block") == b).select("item_id", F.col("i").alias("_i")), F.col("i") == F.col("_i")))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return cut(reduce(DataFrame.unionByName, out).select("item_id", "rank", F.when(F.col("known"), F.col("id")).alias("doc_id"), "score"), "ranked")
