"""Stateful jobs whose state ends: list and value state with timers of event time. They need the RocksDB state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """The state store that these jobs need, for queries of the session that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Uptake(StatefulProcessor):
    """State of a target: the suggestions that no visit has closed, as a list; each goes `horizon` milliseconds after it was made."""

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "id long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        closed = []
        for r in pd.concat(rows).sort_values("at", kind="stable").itertuples():
            at = int(r.at)
            held = [x for x in held if x[1] + 1000 * self.horizon > at]
            if pd.isna(r.id):
                closed += [(i, key[0], t, at) for i, t in held if t < at]
                held = [x for x in held if x[1] >= at]
            else:
                held.append((int(r.id), at))
                self.handle.registerTimer(at // 1000 + self.horizon)
        self._keep(held)
        yield pd.DataFrame(closed, columns=["id", "target", "ts", "followed_at"]).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        self._keep([tuple(x) for x in self.open.get() if x[1] // 1000 + self.horizon > now] if self.open.exists() else [])
        yield pd.DataFrame([], columns=["id", "target", "ts", "followed_at"]).astype("int64")

    def _keep(self, held: list[tuple[int, int]]) -> None:
        if held:
            self.open.put(held)
        elif self.open.exists():
            self.open.clear()

    def close(self) -> None:
        pass


def uptake(rows: DataFrame, horizon: str = "30 days", late: str = "1 hour") -> DataFrame:
    """rows (target, ts, id): suggestions have an id, visits none -> (id, target, ts, followed_at) in microseconds as visits close suggestions.

    A visit closes all that are open, earlier and not older than the horizon. Rows of a target are taken in order of time within
    a trigger, so triggers must not go back in time. Once the watermark has passed a suggestion's horizon it is forgotten, and
    a target without open suggestions has no state.
    """
    milliseconds = int(pd.Timedelta(horizon).total_seconds() * 1000)
    timed = rows.select("target", "ts", F.unix_micros("ts").alias("at"), "id").withWatermark("ts", late)
    return timed.groupBy("target").transformWithStateInPandas(Uptake(milliseconds), "id long, target long, ts long, followed_at long", "Append", "eventTime")


class Cache(StatefulProcessor):
    """State of a key: when its last answer ends, and what tells whether it has changed. It goes `keep` milliseconds after it ended."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", "ends long, etag string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends, etag = self.row.get() if self.row.exists() else (None, None)
        out = []
        for r in pd.concat(rows).sort_values(["at", "seq"]).itertuples():
            at = int(r.at)
            if not pd.isna(r.ttl):
                ends, etag = at + int(r.ttl * 1e6), r.etag if isinstance(r.etag, str) else None
                continue
            known = ends is not None and at < ends + 1000 * self.keep
            out.append((key[0], r.seq, "hit" if known and at < ends else "conditional" if known and etag else "miss", etag if known and at >= ends else None))
        if ends is not None:
            self.row.update((ends, etag))
            self.handle.registerTimer(ends // 1000 + self.keep)
        yield pd.DataFrame(out, columns=["key", "seq", "outcome", "etag"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.row.exists() and self.row.get()[0] // 1000 + self.keep <= expiredTimerInfo.getExpiryTimeInMs():
            self.row.clear()
        yield pd.DataFrame([], columns=["key", "seq", "outcome", "etag"])

    def close(self) -> None:
        pass


def cache(rows: DataFrame, keep: str = "7 days", late: str = "1 hour") -> DataFrame:
    """rows (key, seq, ts, ttl, etag): writes have a ttl in seconds, reads none -> (key, seq, outcome, etag) of each read.

    A read against a live answer is a hit; against one that has ended, no longer ago than `keep`, it is conditional if the answer
    had an etag, which goes with the request; else it is a miss. The state of a key ends with that time, too.
    """
    milliseconds = int(pd.Timedelta(keep).total_seconds() * 1000)
    timed = rows.select("key", "seq", "ts", F.unix_micros("ts").alias("at"), "ttl", "etag").withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(Cache(milliseconds), "key string, seq long, outcome string, etag string", "Append", "eventTime")
