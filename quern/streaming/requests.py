"""Rate limiting per client, in batch and as a stream; job states and telemetry."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quern.sources import shared
from quern.streaming.stateful import admit, rate_limit_stream, redeem_tickets_stream

__all__ = ["admit", "rate_limit", "rate_limit_stream", "recover_jobs", "redeem_tickets", "redeem_tickets_stream", "telemetry_stream", "write_changes"]
SCHEMA = "event_id long, client long, ts_us long, accepted boolean"


def rate_limit(requests: DataFrame, limit: int = 100, seconds: int = 60) -> DataFrame:
    """requests (event_id, client, ts_us, and exempt if there is one): accepted of each, in order of time and event_id.

    Rejected requests don't count, so each decision needs the ones before: a client's requests stream through one task in order, with
    only the window in memory. Exempt requests pass and are recorded.
    """
    limit = limit or 100
    exempt = F.coalesce("exempt", F.lit(False)) if "exempt" in requests.columns else F.lit(False)
    ordered = requests.select("event_id", "client", "ts_us", exempt.alias("exempt")).repartition("client").sortWithinPartitions("client", "ts_us", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, window = None, deque()
        for frame in frames:
            accepted = []
            for c, t, free in zip(frame["client"].tolist(), frame["ts_us"].tolist(), frame["exempt"].tolist(), strict=True):
                if c != client:
                    client, window = c, deque()
                accepted += admit([t], window, limit, seconds, [free])
            yield frame.drop(columns="exempt").assign(accepted=accepted)

    return ordered.mapInPandas(run, SCHEMA)


def redeem_tickets(events: DataFrame, seconds: int = 60) -> DataFrame:
    """events (event_id, ticket, ts_us, issued): accepted of each use, that is of each row not issued.

    A use takes the ticket away, whether or not it has expired, so that it counts when the ticket's last row before it, by time and
    event_id, issued it at most `seconds` ago. Null tickets are never accepted.
    """
    order = W.partitionBy("ticket").orderBy("ts_us", "event_id")
    live = F.lag("issued").over(order) & (F.col("ts_us") - F.lag("ts_us").over(order) <= seconds * 1_000_000) & F.col("ticket").isNotNull()
    return events.withColumn("accepted", F.coalesce(live, F.lit(False))).where("not issued").select("event_id", "ticket", "ts_us", "accepted")


def telemetry_stream(samples: DataFrame) -> DataFrame:
    """Running count, total and mean of each phase over a stream of (phase, seconds); for complete or update mode."""
    return samples.groupBy("phase").agg(F.count("*").alias("n"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"))


def write_changes(snapshots: DataFrame, write: Callable[[DataFrame, int], None], *ignored: str, folder: str | None = None) -> DataStreamWriter:
    """A writer of a complete-mode stream that calls write(rows, batch) only where the rows differ from the last ones written, but for
    the ignored columns (a time of the snapshot, say). folder: a shared one, beside the checkpoint say, that keeps a digest of the last
    rows, so that a restart doesn't write them again; it is noted after the writing, so that a crash between writes them twice."""
    spark = snapshots.sparkSession
    noted = f"{folder}/last-written"
    last: dict[str, object] = {"state": shared.read_text(spark, noted)} if folder and shared.exists(spark, noted) else {}

    def each(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        compared = [c for c in rows.columns if c not in ignored]
        state = " ".join(map(str, rows.agg(F.count("*"), F.sum(F.xxhash64(*compared).cast("decimal(38,0)"))).first()))
        if state != last.get("state"):
            write(rows, batch)
            last["state"] = state
            if folder:
                shared.delete(spark, noted)
                shared.write_new(spark, noted, state)
        rows.unpersist()

    return snapshots.writeStream.outputMode("complete").foreachBatch(each)


def recover_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that were in flight when the log was last written were interrupted."""
    return jobs.withColumn("status", F.when(F.col("status").isin("pending", "in_progress", "running"), "interrupted").otherwise(F.col("status")))
