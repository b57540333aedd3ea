"""State on streams against the same in batch: over several batches, with a restart between."""

import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.streaming import jobs, requests


def streamed(spark, frame, parts, work, folder):
    """The rows that work(stream) appends when frame's rows come in parts (lists of conditions), each by a query of its own."""
    out = []
    os.makedirs(f"{folder}/in")
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for k, part in enumerate(parts):
        frame.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        sink = []
        q = work(source).writeStream.outputMode("append").foreachBatch(lambda rows, _, sink=sink: sink.extend(rows.collect())).option("checkpointLocation", f"{folder}/cp").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        out += [tuple(r) for r in sink]
    return out


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_limits_with_exempt_requests_over_restarts(spark, tmp_path):
    rng = random.Random(2)
    made = [(i, rng.randrange(4), i * 3_000_000, rng.random() < 0.2) for i in range(200)]
    frame = spark.createDataFrame(made, "event_id long, client long, ts_us long, exempt boolean")
    got = streamed(spark, frame, ["event_id < 70", "event_id between 70 and 71", "event_id > 71"], lambda s: requests.rate_limit_stream(s, 4, idle_seconds=None), str(tmp_path))
    want = rows(requests.rate_limit(frame, 4))
    assert sorted(got) == want and {r[3] for r in want} == {True, False}
    assert all(r[3] for r, m in zip(want, sorted(made), strict=True) if m[3])  # exempt ones pass


def test_tickets_are_used_once_over_restarts(spark, tmp_path):
    rng = random.Random(3)
    made = [(i, rng.randrange(25), 10**15 + i * 5_000_000, rng.random() < 0.5) for i in range(240)]
    frame = spark.createDataFrame(made, "event_id long, ticket long, ts_us long, issued boolean")
    got = streamed(spark, frame, ["event_id < 100", "event_id >= 100"], lambda s: requests.redeem_tickets_stream(s, 120), str(tmp_path))
    want = rows(requests.redeem_tickets(frame, 120))
    assert sorted(got) == want and {r[3] for r in want} == {True, False}


def test_tickets_that_ended_leave_no_state(spark, tmp_path):
    frame = spark.createDataFrame([(i, i, 10**15 + i * 1_000_000, True) for i in range(20)] + [(99, 99, 10**15 + 10**10, False)], "event_id long, ticket long, ts_us long, issued boolean")
    os.makedirs(f"{tmp_path}/in")
    source = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    frame.where("event_id < 99").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = requests.redeem_tickets_stream(source, 60, late_seconds=10).writeStream.format("noop").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        held = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
        assert max(held) >= 20
        frame.where("event_id = 99").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q.processAllAvailable()
        for _ in range(60):
            held = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
            if held[-1] == 0:
                break
            q.processAllAvailable()
        assert held[-1] == 0
    finally:
        q.stop()


def walked(made):
    out, state = [], {}
    moves = {(s, e): after for before, e, after in jobs.MOVES for s in before.split()}
    for job, seq, event in sorted(made, key=lambda r: (r[0], r[1])):
        before = state.get(job, "none")
        state[job] = moves.get((before, event), before)
        out.append((job, seq, event, state[job], (before, event) in moves))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(4)
    events = [*jobs.EVENTS, "reading", "parsing", "embedding", "unheard of", None]
    return [(0, i, rng.choice(events)) for i in range(3000)] + [(rng.randrange(1, 60), 10_000 + i, rng.choice(events)) for i in range(900)]  # one job is most of the log


def test_jobs_agree_with_a_walk(spark, made):
    frame = spark.createDataFrame(made, "job_id long, seq long, event string").repartition(6).withColumn("part", F.lit("clash"))
    assert sorted((tuple(r) for r in jobs.job_states(frame).collect()), key=repr) == walked(made)
    assert jobs.job_states(frame.limit(0)).count() == 0
    assert jobs.job_states(frame.limit(3).withColumn("job_id", F.lit(None).cast("long"))).count() == 0


def test_runs_compose():
    rng = random.Random(5)
    every = jobs.run_of([], np.arange(len(jobs.STATES)))
    for _ in range(50):
        events = [rng.choice([*jobs.EVENTS, None]) for _ in range(rng.randrange(12))]
        cut = rng.randrange(len(events) + 1)
        one, other = jobs.run_of(events[:cut], every), jobs.run_of(events[cut:], every)
        assert jobs.run_of(events, every).tolist() == other[one].tolist()


def test_jobs_on_a_stream(spark, tmp_path, made):
    some = [m for m in made if m[0] or m[1] < 200]
    frame = spark.createDataFrame(some, "job_id long, seq long, event string")
    got = streamed(spark, frame, ["seq < 150", "seq between 150 and 10300", "seq > 10300"], jobs.job_states_stream, str(tmp_path))
    assert sorted(got, key=repr) == walked(some)


def test_unchanged_snapshots_are_not_written_again_after_a_restart(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    frame = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "phase string, seconds double")
    source = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    written = []

    def run():
        snapshots = requests.telemetry_stream(source).withColumn("at", F.current_timestamp())
        q = requests.write_changes(snapshots, lambda rows, _: written.append(rows.count()), "at", folder=f"{tmp_path}/cp").option("checkpointLocation", f"{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    frame.write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert written == [2]
    frame.limit(0).write.mode("append").parquet(f"{tmp_path}/in")  # a batch without rows
    run()
    assert written == [2]
    frame.limit(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert written == [2, 2]


def test_jobs_are_folded_without_a_call_for_each(spark):
    rng = random.Random(9)
    events = pd.Series([rng.choice([*jobs.EVENTS, None, "unheard of"]) for _ in range(300)])
    first = np.array([0, 1, 2, 70, 71, 299])
    got = jobs._composed(events, first)
    for b, e in zip(first, [*first[1:], 300], strict=True):
        for i in range(b, e):
            assert got[i].tolist() == jobs.run_of(events[b : i + 1].tolist(), np.arange(len(jobs.STATES))).tolist()
    frame = spark.createDataFrame([(1, 1, "queued"), (2, 1, "queued")], "job_id long, seq long, event string")
    assert "FlatMapGroupsInPandas" not in jobs.job_states(frame)._jdf.queryExecution().executedPlan().toString()
