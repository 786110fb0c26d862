"""Stateful jobs over streams of observations; each has a batch twin among the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftpage.operators.log import log_facts, outcome, resolve_verdicts


def running_verdicts(observations: DataFrame) -> DataFrame:
    """The verdict of every fetch so far (output mode update or complete); resolution takes observations in any order."""
    return resolve_verdicts(observations)


def latency_windows(events: DataFrame, late: str, width: str = "1 hour") -> DataFrame:
    """events (event_type, ts, value) -> (event_type, started, n, mean, most) in windows of that width; state ends when rows are too late."""
    w = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", width).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most")).select("event_type", F.col("w.start").alias("started"), "n", "mean", "most")


def first_hints(hints: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Each hint once for its keys, as long as the watermark remembers it."""
    return hints.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def failure_state(events: DataFrame, threshold: int) -> DataFrame:
    """events (key, seq, failed) in order of seq -> (key, seen, longest_run, opened) after each batch; the state is four numbers a key."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, run, longest, opened = state.get if state.exists else (0, 0, 0, 0)
        rows = pd.concat(batches).sort_values("seq")
        for failed in rows["failed"]:
            run = run + 1 if failed else 0
            longest, opened = max(longest, run), opened + (run == threshold)
        seen += len(rows)
        state.update((seen, run, longest, opened))
        yield pd.DataFrame({"key": [key[0]], "seen": [seen], "longest_run": [longest], "opened": [opened]})

    return events.groupBy("key").applyInPandasWithState(update, "key long, seen long, longest_run long, opened long", "seen long, run long, longest long, opened long", "update", GroupStateTimeout.NoTimeout)


def breaker_state(rows: DataFrame, threshold: int = 5, ttl: float = 30.0) -> DataFrame:
    """rows (host, seq, at, failed) -> (host, seq, allowed): a breaker opens after so many failures in a row and lets a trial
    through when ttl seconds have gone; a call that is not allowed changes nothing. State: failures in a row, and open till when."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, until = state.get if state.exists else (0, float("-inf"))
        out = []
        for r in pd.concat(batches).sort_values("seq").itertuples():
            allowed = r.at >= until
            if allowed:
                run = run + 1 if r.failed else 0
                until = r.at + ttl if run >= threshold else float("-inf")
            out.append((key[0], r.seq, allowed))
        state.update((int(run), float(until)))
        yield pd.DataFrame(out, columns=["host", "seq", "allowed"])

    return rows.groupBy("host").applyInPandasWithState(update, "host long, seq long, allowed boolean", "run int, until double", "append", GroupStateTimeout.NoTimeout)


def running_facts(observations: DataFrame) -> DataFrame:
    """(fetch_id, verdict, outcome, last) of every fetch so far; all facts are aggregates that take observations in any order."""
    found = log_facts(observations)
    return found.select("fetch_id", "verdict", outcome().alias("outcome"), F.col("last.verdict").alias("last"))


def open_cells(events: DataFrame) -> DataFrame:
    """events (system, cell, ended) -> (system, started, ended, in_flight): the cells of an evaluation that are under way (complete mode)."""
    g = events.groupBy("system").agg(F.count_if(~F.col("ended")).alias("started"), F.count_if("ended").alias("ended"))
    return g.withColumn("in_flight", F.col("started") - F.col("ended"))


def live_summary(events: DataFrame, say, every: str = "30 seconds"):
    """A query that says one line a system at each trigger: how many cells have ended and how many are under way."""

    def tell(batch: DataFrame, _: int) -> None:
        for r in batch.orderBy("system").collect():  # one row a system
            say(f"{r['system']}: {r['ended']} done, {r['in_flight']} in flight")

    return open_cells(events).writeStream.outputMode("complete").trigger(processingTime=every).foreachBatch(tell)
