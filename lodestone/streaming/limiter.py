"""Request limits: for tables as window functions, for streams as keyed state; both decide each event in the order of ts and event_id."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DECISION = "event_id long, allowed boolean"


def _seconds() -> Column:
    return F.unix_seconds(F.col("ts").cast("timestamp"))


def window_allowed(events: DataFrame, key: str, seconds: int, cap: int) -> DataFrame:
    """events with allowed: whether no more than cap attempts of the key, this one included, fall into its fixed window. cap 0: no limit."""
    n = F.row_number().over(Window.partitionBy(key, F.floor(_seconds() / seconds)).orderBy("ts", "event_id"))
    return events.withColumn("allowed", n <= cap if cap > 0 else F.lit(True))


def daily_allowed(events: DataFrame, cap: int) -> DataFrame:
    """events with allowed: the first cap of each UTC day. A day's cap-th event is found from counts by second, so no day meets in one task."""
    if cap <= 0:
        return events.withColumn("allowed", F.lit(True))
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    df = events.withColumns({"_day": day, "_s": _seconds()})
    upto = F.sum("_n").over(Window.partitionBy("_d").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0))
    counts = df.groupBy(F.col("_day").alias("_d"), F.col("_s").alias("_t")).agg(F.count("*").alias("_n")).withColumn("_before", upto - F.col("_n"))
    counts = counts.filter((F.col("_before") < cap) & (F.col("_before") + F.col("_n") > cap)).select("_d", F.col("_t").alias("_edge"), "_before")
    last = df.groupBy(F.col("_day").alias("_d")).agg(F.count("*").alias("_total"))
    edges = last.join(counts, "_d", "left").withColumn("_full", F.col("_edge").isNull())
    # A cap that falls between two seconds has no edge: the second is then the first whose events before it fill the cap.
    firsts = df.groupBy(F.col("_day").alias("_d"), F.col("_s").alias("_t")).agg(F.count("*").alias("_n")).withColumn("_before", upto - F.col("_n"))
    firsts = firsts.filter(F.col("_before") >= cap).groupBy("_d").agg(F.min("_t").alias("_after"))
    edges = edges.join(firsts, "_d", "left").select("_d", "_edge", "_before", "_after")
    df = df.join(edges, F.col("_day") == F.col("_d"))
    at_edge = F.coalesce(F.col("_s") == F.col("_edge"), F.lit(False))
    n = F.row_number().over(Window.partitionBy("_day", F.when(at_edge, F.lit(-1)).otherwise(F.col("_s"))).orderBy("ts", "event_id"))
    allowed = F.when(at_edge, F.col("_before") + n <= cap).otherwise(F.coalesce(F.col("_s") < F.coalesce("_edge", "_after"), F.lit(True)))
    return df.withColumn("allowed", allowed).select(*events.columns, "allowed")


def gates(events: DataFrame, human: Column, seconds: int, per_key: int, per_day: int, key: str = "user_id") -> DataFrame:
    """events with verdict: not_human, ip, day or allowed. What an earlier gate rejects uses up nothing of a later one."""
    df = events.withColumn("_human", human)
    passed = window_allowed(df.filter("_human"), key, seconds, per_key).withColumnRenamed("allowed", "_ip")
    last = daily_allowed(passed.filter("_ip"), per_day)
    columns = events.columns
    return (
        df.filter("NOT _human").select(*columns, F.lit("not_human").alias("verdict"))
        .unionByName(passed.filter("NOT _ip").select(*columns, F.lit("ip").alias("verdict")))
        .unionByName(last.select(*columns, F.when(F.col("allowed"), "allowed").otherwise("day").alias("verdict")))
    )


def client_ip(cf: Column, forwarded: Column, peer: Column) -> Column:
    """The first of these that says something, else unknown; of forwarded addresses the first."""
    said = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(said(cf), said(F.get(F.split(forwarded, ","), F.lit(0))), said(peer), F.lit("unknown"))


def spikes(events: DataFrame, key: str, seconds: int, threshold: int, late: str | None = None) -> DataFrame:
    """Fixed windows in which a key has at least threshold events; late is a stream's watermark."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        df = df.withWatermark("ts", late)
    found = df.groupBy(key, F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("n"))
    return found.filter(F.col("n") >= threshold).select(key, F.col("window.start").alias("begin"), "n")


class _Limiter(StatefulProcessor):
    """Of each key the current window and the attempts in it; idle keys go when their time to live ends."""

    def __init__(self, seconds: int, cap: int) -> None:
        self.seconds, self.cap = seconds, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "slot long, n long", ttlDurationMs=10 * self.seconds * 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        slot, n = self.count.get() if self.count.exists() else (-1, 0)
        pdf = pd.concat(list(rows)).sort_values(["us", "event_id"])
        out = []
        for us in pdf["us"]:
            now = int(us) // (self.seconds * 1_000_000)
            slot, n = (slot, n + 1) if now == slot else (now, 1)
            out.append(n <= self.cap or self.cap <= 0)
        self.count.update((slot, n))
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "allowed": out})

    def close(self) -> None:
        pass


class _BoundedLimiter(StatefulProcessor):
    """Of a share of the keys: each one's window, the attempts in it and when it was last seen; no more than `most` of them after a batch. Keys whose window is over go
    first, then those that were seen longest ago: a key that stays, and one that comes anew after its window, are decided as if nothing had gone."""

    def __init__(self, key: str, seconds: int, cap: int, most: int) -> None:
        self.key, self.seconds, self.cap, self.most = key, seconds, cap, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "k string", "slot long, n long, seen long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {k[0]: tuple(v) for k, v in self.held.iterator()}
        pdf = pd.concat(list(rows)).sort_values(["us", "event_id"])
        out, touched = [], set()
        for k, us in zip(pdf["k"], pdf["us"], strict=True):
            now = int(us) // (self.seconds * 1_000_000)
            slot, n, _ = held.get(k, (now, 0, 0))
            held[k] = (now, n + 1 if slot == now else 1, int(us))
            touched.add(k)
            out.append(held[k][1] <= self.cap or self.cap <= 0)
        latest = max(v[0] for v in held.values())
        going = sorted(held, key=lambda k: (held[k][0] == latest, held[k][2], k))[: max(0, len(held) - self.most)]
        for k in going:
            del held[k]
            if self.held.containsKey((k,)):
                self.held.removeKey((k,))
        for k in touched & held.keys():
            self.held.updateValue((k,), held[k])
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "allowed": out, "held": len(held)})

    def close(self) -> None:
        pass


#: Shares that keys are dealt to, each with its part of the bound.
SHARES = 16


def bounded_allowed(events: DataFrame, key: str, seconds: int, cap: int, most: int, shares: int = SHARES) -> DataFrame:
    """The decisions of stream_allowed with at most `most` keys in the state after any batch, and held, how many a share's state holds then. Keys are dealt to shares by a hash; a
    share keeps most / shares of them."""
    if most < shares:
        raise ValueError("a bound below the number of shares holds no key")
    df = events.select(F.col(key).cast("string").alias("k"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    df = df.withColumn("share", F.pmod(F.xxhash64("k"), F.lit(shares)))
    return df.groupBy("share").transformWithStateInPandas(_BoundedLimiter(key, seconds, cap, most // shares), outputStructType=f"{DECISION}, held long", outputMode="Append", timeMode="None")


def stream_allowed(events: DataFrame, key: str, seconds: int, cap: int) -> DataFrame:
    """The same decisions as window_allowed over a stream (key, event_id, ts) whose batches come in order of time."""
    df = events.select(key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return df.groupBy(key).transformWithStateInPandas(_Limiter(seconds, cap), outputStructType=DECISION, outputMode="Append", timeMode="ProcessingTime")
