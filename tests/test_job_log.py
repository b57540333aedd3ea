"""The log of jobs: retention, states after a restart, writes that fail, writers that meet."""

import os

import pytest
from pyspark.sql import functions as F

from quern.operators import listing
from quern.sources import files, shared
from quern.streaming import job_log


def jobs(spark, n, status="running"):
    return spark.range(n).select(F.col("id").alias("job_id"), F.when(F.col("id") % 2 == 0, status).otherwise("failed").alias("status"), F.lit(1.0).alias("progress"))


def test_log_keeps_the_last_jobs(spark, tmp_path):
    folder = str(tmp_path / "log")
    with pytest.raises(ValueError, match="no log"):
        job_log.read(spark, folder)
    job_log.write(jobs(spark, 500), folder, "job_id", derived=["progress", "not there"])
    got = {r.job_id: r.status for r in job_log.read(spark, folder).collect()}
    assert got == {i: "failed" if i % 2 else "interrupted" for i in range(300, 500)}
    assert job_log.read(spark, folder).columns == ["job_id", "status"]
    before = job_log.read(spark, folder)
    job_log.write(jobs(spark, 3, "completed"), folder, "job_id")
    assert before.count() == 200  # who reads the log before can go on
    assert {r.status for r in job_log.read(spark, folder).collect()} == {"completed", "failed"}
    job_log.write(jobs(spark, 0), folder, "job_id")
    assert job_log.read(spark, folder).count() == 0
    assert len([n for n in os.listdir(folder) if n.startswith("log-")]) == 2


def test_failed_and_racing_writes(spark, tmp_path):
    folder = str(tmp_path / "log")
    job_log.write(jobs(spark, 5), folder, "job_id")
    broken = jobs(spark, 5).withColumn("status", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        job_log.write(broken, folder, "job_id")
    assert job_log.read(spark, folder).count() == 5
    assert not shared.write_new(spark, f"{folder}/{job_log.CURRENT}{1:012d}", "x")  # a number is taken once


def test_newest_and_request_sums(spark):
    rows = spark.createDataFrame([(1, 5), (2, 7), (3, 7), (4, None)], "id int, at int")
    assert [r.id for r in listing.newest(rows, 3, "at", "id").collect()] == [3, 2, 1]
    with pytest.raises(ValueError):
        listing.newest(rows, 0, "id")
    uploads = spark.createDataFrame([("a", 10), ("a", None), ("b", files.MAX_FILE_BYTES + 1), ("c", 90)] + [("d", 0)] * 501, "request string, bytes long")
    got = {r.request: (r.files, r.bytes, r.admitted) for r in files.request_sums(uploads, "request", 80).collect()}
    assert got == {"a": (2, 10, True), "b": (1, files.MAX_FILE_BYTES + 1, False), "c": (1, 90, False), "d": (501, 0, False)}
    assert files.request_sums(uploads.limit(0), "request").count() == 0
