"""Keyed state on streams: sliding windows of requests, and tickets that are used once."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str = "None") -> DataFrame:
    """rows grouped by a key and handled by a processor. Such state is kept in RocksDB, which the session's setting must name."""
    spark = rows.sparkSession
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", time)


def admit(times: list[int], window: deque, limit: int, seconds: int = 60, exempt: list[bool] | None = None) -> list[bool]:
    """Entries of age >= seconds leave the window; a request is accepted, and recorded, while fewer than limit are in it, or if exempt."""
    out = []
    for k, t in enumerate(times):
        while window and t - window[0] >= seconds * 1_000_000:
            window.popleft()
        out.append(len(window) < limit or bool(exempt and exempt[k]))
        if out[-1]:
            window.append(t)
    return out


class Limiter(StatefulProcessor):
    """The window of a client is a list of times. New ones are appended to it; it is written anew only where some have left it. A timer
    clears it when nothing has come from the client for a while."""

    def __init__(self, limit: int, seconds: int, idle_seconds: int | None):
        self.limit, self.seconds, self.idle_seconds = limit, seconds, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.times = handle, handle.getListState("times", "t long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts_us", "event_id"])
        before = [t for (t,) in self.times.get()] if self.times.exists() else []
        window = deque(before)
        accepted = admit(frame["ts_us"].tolist(), window, self.limit, self.seconds, frame["exempt"].tolist())
        stays = len(window) - sum(accepted)  # of the times before, if none of the new ones has left already
        if before and stays == len(before):
            self.times.appendList([(t,) for t in list(window)[stays:]]) if sum(accepted) else None
        else:
            self.times.put([(t,) for t in window])
        if self.idle_seconds is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + max(self.idle_seconds, self.seconds) * 1000)
        yield frame[["event_id", "client", "ts_us"]].assign(accepted=accepted)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield pd.DataFrame({"event_id": pd.array([], "int64"), "client": pd.array([], "int64"), "ts_us": pd.array([], "int64"), "accepted": pd.array([], "bool")})

    def close(self) -> None:
        pass


class Tickets(StatefulProcessor):
    """The time of a ticket's issue, until it is used or, by the events' own time, can't be used any more."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.issued = handle, handle.getValueState("issued", "ts_us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts_us", "event_id"])
        live = self.issued.get()[0] if self.issued.exists() else None
        accepted = []
        for t, issued in zip(frame["ts_us"].tolist(), frame["issued"].tolist(), strict=True):
            accepted.append(not issued and live is not None and t - live <= self.seconds * 1_000_000)
            live = t if issued else None
        if live is None:
            self.issued.clear()
        else:
            self.issued.update((live,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(live // 1000 + self.seconds * 1000 + 1)
        yield frame.assign(accepted=accepted)[~frame["issued"].to_numpy(dtype=bool)][["event_id", "ticket", "ts_us", "accepted"]]

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.issued.clear()
        yield pd.DataFrame({"event_id": pd.array([], "int64"), "ticket": pd.array([], "int64"), "ts_us": pd.array([], "int64"), "accepted": pd.array([], "bool")})

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, limit: int = 100, seconds: int = 60, idle_seconds: int | None = 3600) -> DataFrame:
    """requests.rate_limit() on a stream (event_id, client, ts_us, and exempt if there is one); a micro-batch is decided in order of time.

    The state of a client of whom nothing came for idle_seconds of the clock is dropped, for which the query goes on with batches without
    data. None: it is kept for ever. Other columns are dropped.
    """
    exempt = F.coalesce("exempt", F.lit(False)) if "exempt" in requests.columns else F.lit(False)
    lean = requests.select("event_id", "client", "ts_us", exempt.alias("exempt"))
    return with_state(lean, "client", Limiter(limit or 100, seconds, idle_seconds), "event_id long, client long, ts_us long, accepted boolean", "None" if idle_seconds is None else "ProcessingTime")


def redeem_tickets_stream(events: DataFrame, seconds: int = 60, late_seconds: int = 600) -> DataFrame:
    """requests.redeem_tickets() on a stream (event_id, ticket, ts_us, issued) with long tickets: accepted of each use.

    A ticket is used once, whatever batches and restarts lie between; when the stream's own time has passed its end, its state goes. Rows
    that come over late_seconds behind that time are dropped, as are null tickets, which are never accepted.
    """
    timed = events.where("ticket is not null").select("event_id", "ticket", "ts_us", F.coalesce("issued", F.lit(False)).alias("issued"), F.timestamp_micros("ts_us").alias("at"))
    return with_state(timed.withWatermark("at", f"{late_seconds} seconds"), "ticket", Tickets(seconds), "event_id long, ticket long, ts_us long, accepted boolean", "EventTime")
