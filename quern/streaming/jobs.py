"""The life of jobs: states from logged events, by an associative fold, and the same on a stream.

A run of events, whatever state it begins in, ends in a state that depends on that one alone: it is a table of as many entries as there are
states, and the table of two runs after each other is one looked up in the other. So the events of a long job needn't go through one task:
each range of the log makes the tables of the jobs in it, tables of a job are composed in order, which gives the state that each range begins
with, and the ranges are read again from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern.sources.shared import settled
from quern.streaming.stateful import with_state

#: States, of which the first is that of a job that isn't known yet, and events.
STATES = ["none", "pending", "reading", "parsing", "embedding", "finalizing", "completed", "failed", "interrupted"]
EVENTS = ["queued", "reading", "parsing", "embedding", "finalizing", "completed", "failed", "restarted"]
#: (states, event, state after). The next file of a batch is read after any stage; a file without chunks is done after parsing. A restart
#: interrupts what waits or runs and changes nothing else. All else is invalid and changes nothing.
MOVES = [
    ("none", "queued", "pending"),
    ("pending parsing embedding finalizing", "reading", "reading"),
    ("reading", "parsing", "parsing"),
    ("parsing", "embedding", "embedding"),
    ("embedding", "finalizing", "finalizing"),
    ("parsing finalizing", "completed", "completed"),
    ("pending reading parsing embedding finalizing", "failed", "failed"),
    ("pending reading parsing embedding finalizing", "restarted", "interrupted"),
    *((s, "restarted", s) for s in ("none", "completed", "failed", "interrupted")),
]
INVALID = -1
OUT = "job_id long, seq long, event string, state string, valid boolean"


def table() -> np.ndarray:
    """NEXT[event, state], INVALID where it isn't allowed; one more row for events that aren't known."""
    out = np.full((len(EVENTS) + 1, len(STATES)), INVALID)
    for before, event, after in MOVES:
        out[EVENTS.index(event), [STATES.index(s) for s in before.split()]] = STATES.index(after)
    return out


NEXT = table()
STAYS = np.where(NEXT == INVALID, np.arange(len(STATES)), NEXT)
_NUMBER = {e: i for i, e in enumerate(EVENTS)}


def run_of(events: list[str | None], begin: np.ndarray) -> np.ndarray:
    """The states after events, for each state in begin."""
    for e in events:
        begin = STAYS[_NUMBER.get(e, len(EVENTS))][begin]
    return begin


def _numbers(events: pd.Series) -> np.ndarray:
    return events.map(_NUMBER).fillna(len(EVENTS)).to_numpy().astype(int)


def _firsts(frame: pd.DataFrame) -> np.ndarray:
    """Where runs of one part and job begin."""
    new = np.ones(len(frame), bool)
    for name in ("part", "job_id"):
        column = frame[name].to_numpy()
        new[1:] = column[1:] != column[:-1] if name == "part" else new[1:] | (column[1:] != column[:-1])
    return np.flatnonzero(new)


def _composed(events: pd.Series, first: np.ndarray) -> np.ndarray:
    """For each event and each state that its run may begin in, the state after it. Tables of twice as many events in each round."""
    tables, rows = STAYS[_numbers(events)], np.arange(len(events))
    lengths = np.diff(np.append(first, len(events)))
    place, step = rows - np.repeat(first, lengths), 1
    while step < lengths.max(initial=0):
        late = rows[place >= step]
        tables[late] = np.take_along_axis(tables[late], tables[late - step], axis=1)
        step *= 2
    return tables


def replay(events: list[str | None], state: int) -> tuple[list[str], list[bool], int]:
    """Of each event the state after it and whether it was valid; the last state."""
    states, valid = [], []
    for e in events:
        after = NEXT[_NUMBER.get(e, len(EVENTS))][state]
        valid.append(bool(after != INVALID))
        state = int(after) if after != INVALID else state
        states.append(STATES[state])
    return states, valid, state


def job_states(events: DataFrame) -> DataFrame:
    """events (job_id, seq, event) in order of seq: job_id, seq, event, state (after it) and valid.

    seq is distinct within a job. Null and unknown events are invalid; rows with a null job_id are left out. Other columns are dropped. A job
    of any length is spread over ranges of the log; only their tables, one row a range and job, meet by job.
    """
    lean = events.where("job_id is not null").select(F.col("job_id").cast("long"), F.col("seq").cast("long"), F.col("event").cast("string"))
    order = ["job_id", "seq", "event"]
    ranged = settled(lean.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.repartition("part").sortWithinPartitions("part", *order)

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, None  # the run that the last frame ended in, and its table
        row = lambda: pd.DataFrame({"part": [key[0]], "job_id": [key[1]], "after": [now.tolist()]})
        for frame in (f for f in frames if len(f)):
            first = _firsts(frame)
            tables = _composed(frame["event"], first)
            goes_on = key == (frame["part"].iloc[0], frame["job_id"].iloc[0])
            if goes_on:
                n = first[1] if len(first) > 1 else len(frame)
                tables[:n] = tables[:n, now]
            elif key is not None:
                yield row()
            ends = first[1:] - 1
            yield frame[["part", "job_id"]].iloc[ends].assign(after=tables[ends].tolist())
            key, now = (frame["part"].iloc[-1], frame["job_id"].iloc[-1]), tables[-1]
        if key is not None:
            yield row()

    tables = in_order(ranged).select("part", *order).mapInPandas(runs, "part int, job_id long, after array<int>")
    # as many rows as a job has ranges
    step = lambda a, r: F.struct(F.get(r["after"], a["state"]).alias("state"), F.concat(a["begins"], F.array(F.struct(r["part"].alias("part"), a["state"].alias("begin")))).alias("begins"))
    start = F.struct(F.lit(0).alias("state"), F.expr("cast(array() as array<struct<part:int,begin:int>>)").alias("begins"))
    begins = F.aggregate(F.array_sort(F.collect_list(F.struct("part", "after"))), start, step, lambda a: a["begins"])
    started = tables.groupBy("job_id").agg(begins.alias("begins")).select("job_id", F.inline("begins"))

    def replayed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, 0
        for frame in (f for f in frames if len(f)):
            first = _firsts(frame)
            begin = frame["begin"].to_numpy()[first].astype(int)
            if key == (frame["part"].iloc[0], frame["job_id"].iloc[0]):
                begin[0] = state
            begin = np.repeat(begin, np.diff(np.append(first, len(frame))))
            after = _composed(frame["event"], first)[np.arange(len(frame)), begin]
            before = np.append(0, after[:-1])
            before[first] = begin[first]
            valid = NEXT[_numbers(frame["event"]), before] != INVALID
            yield frame[order].assign(state=np.array(STATES, dtype=object)[after], valid=valid)
            key, state = (frame["part"].iloc[-1], frame["job_id"].iloc[-1]), after[-1]

    joined = in_order(ranged.join(started, ["part", "job_id"]))
    return joined.select("part", "begin", *order).mapInPandas(replayed, OUT)


class _Jobs(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["seq", "event"])
        begin = self.state.get()[0] if self.state.exists() else 0
        states, valid, last = replay(frame["event"].tolist(), begin)
        self.state.update((last,))
        yield frame[["job_id", "seq", "event"]].assign(state=states, valid=valid)

    def close(self) -> None:
        pass


def job_states_stream(events: DataFrame) -> DataFrame:
    """The same on a stream whose batches come in order: the state of each job is kept from batch to batch, and over restarts."""
    lean = events.where("job_id is not null").select(F.col("job_id").cast("long"), F.col("seq").cast("long"), F.col("event").cast("string"))
    return with_state(lean, "job_id", _Jobs(), OUT)
