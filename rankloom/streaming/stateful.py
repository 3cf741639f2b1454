"""Stateful sequential operators: pure state machines, a batch form per key, and streaming forms."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


class SlidingWindowLimiter:
    """At most ``limit`` accepted events within ``window`` seconds; denied ones do not count."""

    def __init__(self, limit: int, window: float, held: list[float] | None = None):
        self.limit, self.window, self.held = limit, window, deque(held or [])

    def allow(self, at: float) -> tuple[bool, float]:
        while self.held and self.held[0] <= at - self.window:
            self.held.popleft()
        if len(self.held) >= self.limit:
            return False, self.held[0] + self.window - at
        self.held.append(at)
        return True, 0.0


def rate_limit(events: DataFrame, *, key: str, ts: str, order: str, limit: int, window: float) -> DataFrame:
    """Batch form: key, order, allowed, retry_after for every event; one grouped-map call per key, its events in time order."""
    cols = events.select(F.col(key).cast("string").alias("k"), F.col(order).alias("o"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "o"])
        lim = SlidingWindowLimiter(limit, window)
        res = [lim.allow(t / 1e6) for t in pdf.t]
        return pd.DataFrame({"k": pdf.k, "o": pdf.o, "allowed": [r[0] for r in res], "retry_after": [r[1] for r in res]})

    kind = events.schema[order].dataType.simpleString()
    return cols.groupBy("k").applyInPandas(run, f"k string, o {kind}, allowed boolean, retry_after double")


def rate_limit_stream(events: DataFrame, *, key: str, ts: str, limit: int, window: float) -> DataFrame:
    """Streaming form with the accepted times as state; idle keys are dropped after two windows."""

    def step(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        lim = SlidingWindowLimiter(limit, window, list(state.get[0]) if state.exists else [])
        for pdf in batches:
            times = sorted(t / 1e6 for t in pdf["t"])
            res = [lim.allow(t) for t in times]
            yield pd.DataFrame({"k": k[0], "t": times, "allowed": [r[0] for r in res]})
        state.update((list(lim.held),))
        state.setTimeoutDuration(int(window * 2000))

    timed = events.select(F.col(key).cast("string").alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    return timed.groupBy("k").applyInPandasWithState(step, "k string, t double, allowed boolean", "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


class KeyPool:
    """Round-robin keys with quota, cooldown and final states."""

    def __init__(self, keys: list[str], quota: int, cooldown: float):
        self.state = {k: {"used": 0, "until": 0.0, "status": "active"} for k in keys}
        self.order, self.next, self.quota, self.cooldown = list(keys), 0, quota, cooldown

    def acquire(self, at: float) -> str | None:
        for i in range(len(self.order)):
            k = self.order[(self.next + i) % len(self.order)]
            s = self.state[k]
            if s["status"] == "active" and s["used"] < self.quota and s["until"] <= at:
                s["used"] += 1
                self.next = (self.next + i + 1) % len(self.order)
                return k
        return None

    def report(self, key: str, status: int, at: float) -> None:
        s = self.state[key]
        if status in (401, 403):
            s["status"] = "invalid"
        elif status == 432:
            s["status"] = "exhausted"
        elif status == 429:
            s["until"] = at + self.cooldown


class AlertState:
    """Transitions of one alert code: first, escalation, repeat, recovery; None keeps the state."""

    LEVEL = {"clean": 0, "warning": 1, "critical": 2}

    def __init__(self, repeat_after: float, recover_after: int):
        self.repeat_after, self.recover_after = repeat_after, recover_after
        self.level, self.last, self.clean = "clean", 0.0, 0

    def observe(self, severity: str | None, at: float) -> str | None:
        if severity is None:
            return None
        if severity == "clean":
            if self.level == "clean":
                return None
            self.clean += 1
            if self.clean >= self.recover_after:
                self.level, self.clean = "clean", 0
                return "recovery"
            return None
        self.clean = 0
        before = self.level
        if before == "clean":
            self.level, self.last = severity, at
            return "first"
        if self.LEVEL[severity] > self.LEVEL[before]:
            self.level, self.last = severity, at
            return "escalation"
        if at - self.last >= self.repeat_after:
            self.last = at
            return "repeat"
        return None


def alert_transitions(observations: DataFrame, *, code: str, ts: str, severity: str, repeat_after: float, recover_after: int) -> DataFrame:
    """Transitions of every code, in time order."""
    cols = observations.select(F.col(code).cast("string").alias("code"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(severity).alias("severity"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state = AlertState(repeat_after, recover_after)
        out = [(c, t, e) for c, t, s in pdf.sort_values("t").itertuples(index=False) if (e := state.observe(s, t / 1e6))]
        return pd.DataFrame(out, columns=["code", "t", "transition"])

    return cols.groupBy("code").applyInPandas(run, "code string, t bigint, transition string")


def budget_ledger(calls: DataFrame, *, by: list[str], order: list[str], budget: int) -> DataFrame:
    """Adds ordinal and granted: the first ``budget`` calls of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return calls.withColumn("ordinal", F.row_number().over(w)).withColumn("granted", F.col("ordinal") <= budget)


def counter_deltas(samples: DataFrame, *, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds delta: growth since the sample before; after a reset the new value itself."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return samples.withColumn("delta", F.when(before.isNull(), F.lit(None).cast("double")).when(F.col(value) < before, F.col(value).cast("double")).otherwise((F.col(value) - before).cast("double")))


def latency_histogram(samples: DataFrame, *, by: list[str], value: str, edges: list[float]) -> DataFrame:
    """(by.., bucket, n, upto): counts per upper edge (the last bucket is open) and their running sum."""
    bucket = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        bucket = F.when(F.col(value) <= e, i).otherwise(bucket)
    counts = samples.filter(F.col(value).isNotNull()).groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("bucket")))


def event_windows(events: DataFrame, *, ts: str, by: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Windowed counts with a watermark: batch or stream alike (an extension, not part of the reference's operators)."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", length, slide) if slide else F.window("at", length), by).agg(F.count("*").alias("n"))


def backoff(attempt: int, base: float, most: float) -> float:
    return min(most, base * 2 ** max(0, attempt - 1))
