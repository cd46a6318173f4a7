"""Admission, rate, duration and idle control of sessions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.numeric import over_budget
from ..params import DEFAULT, Params
from ..sources.session import prepare


@dataclass
class Leases:
    """The running sessions of one server: session -> [address, when its lease ends]. Its memory is
    bounded by the server's cap."""

    held: dict[str, list] = field(default_factory=dict)

    def expire(self, at: float) -> None:
        for session in [s for s, (_, until) in self.held.items() if until <= at]:
            del self.held[session]

    def request(self, action: str, session: str, address: str, at: float, p: Params) -> str | None:
        """The outcome of an ``open``; any other action gives the session's lease back."""
        self.expire(at)
        if action != "open":
            self.held.pop(session, None)
            return None
        if session in self.held:
            return "duplicate"
        if len(self.held) >= p.sessions_max:
            return "server full"
        if sum(a == address for a, _ in self.held.values()) >= p.sessions_per_ip:
            return "address full"
        self.held[session] = [address, at + p.session_minutes * 60]
        return "admitted"


_ADMITTED = "server string, seq long, session string, outcome string"
_REQUEST = ["seq", "at", "action", "session", "address"]


def _outcomes(leases: Leases, server: str, rows: pd.DataFrame, p: Params) -> pd.DataFrame:
    ordered = rows.sort_values("seq", kind="stable")[_REQUEST].itertuples(index=False)
    out = [(server, r.seq, r.session, leases.request(r.action, r.session, r.address, r.at, p)) for r in ordered]
    return pd.DataFrame([x for x in out if x[3]], columns=["server", "seq", "session", "outcome"]).astype({"seq": "int64"})


def admit(requests: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """requests: server, seq (their order), at (seconds), action, session, address -> server, seq, session,
    outcome of each ``open``: a running session isn't admitted twice, and the caps of a server hold in
    total and per address. Leases end when they are given back, or after a session's longest duration."""
    prepare(requests.sparkSession)
    return requests.groupBy("server").applyInPandas(lambda key, rows: _outcomes(Leases(), key[0], rows, p), _ADMITTED)


class Admission(StatefulProcessor):
    """The same on a stream: leases are a server's state, a timer drops those that nobody gives back,
    and a server without leases has no state."""

    def __init__(self, p: Params = DEFAULT):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("leases", StructType([StructField("json", StringType())]))

    def _store(self, leases: Leases, timerValues) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not leases.held:
            self.kept.clear()
            return
        self.kept.update((json.dumps(leases.held),))
        due = min(until for _, until in leases.held.values())
        self.handle.registerTimer(max(int(due * 1000), timerValues.getCurrentProcessingTimeInMs() + 1))

    def _load(self) -> Leases:
        return Leases(json.loads(self.kept.get()[0]) if self.kept.exists() else {})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        leases = self._load()
        out = _outcomes(leases, key[0], pd.concat(list(rows), ignore_index=True), self.p)
        self._store(leases, timerValues)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        leases = self._load()
        leases.expire(timerValues.getCurrentProcessingTimeInMs() / 1000)
        self._store(leases, timerValues)
        return iter(())

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Outcomes from a streaming DataFrame of requests, whose ``at`` are seconds since the epoch."""
    prepare(requests.sparkSession)
    return requests.groupBy("server").transformWithStateInPandas(Admission(p), StructType.fromDDL(_ADMITTED), "Append", "ProcessingTime")


def rate_limited(chunks: DataFrame, rate: float, p: Params = DEFAULT) -> DataFrame:
    """session_id, ts, bytes -> with the running total, elapsed seconds and whether the
    session is over its budget at that row."""
    w = Window.partitionBy("session_id").orderBy("ts", "chunk").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min("ts").over(Window.partitionBy("session_id"))
    total = F.sum("bytes").over(w)
    elapsed = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 1e6
    return chunks.withColumn("total", total).withColumn("elapsed", elapsed).withColumn("over", over_budget(F.col("total"), F.col("elapsed"), rate, p.rate_factor, p.rate_burst_sec))


def within_duration(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Rows of each session up to its longest duration."""
    first = F.min("ts").over(Window.partitionBy("session_id"))
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    return rows.withColumn("age", age).filter(F.col("age") <= p.session_minutes * 60_000_000).drop("age")


def idle_windows(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """session_id, start, end, n: activity split where a session is idle for too long. Works on
    batch and streaming input (a stream needs a watermark on ts)."""
    gap = F.session_window("ts", f"{p.idle_seconds} seconds")
    return rows.groupBy("session_id", gap.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def segment_rows(frames: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """session_id, win_no, probability -> start, end, replay of each segment, in samples."""
    from .segmenter import Segmenter

    prepare(frames.sparkSession)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        s = Segmenter(p=p)
        found = [x for v in frame.sort_values("win_no").probability if (x := s.frame(v))]
        if last := s.flush():
            found.append(last)
        return pd.DataFrame([(key[0], i, *x) for i, x in enumerate(found)], columns=["session_id", "segment", "start", "end", "replay"])

    return frames.groupBy("session_id").applyInPandas(run, "session_id string, segment int, start long, end long, replay boolean")
