"""The log of jobs in a shared folder: the last jobs by insertion, replaced as a whole by whoever writes.

A write makes a new Parquet folder and then one small numbered file that names it; the greatest number is the log. A write that fails before
that changes nothing, and two writers get different numbers. The log before stays until the next write, for those who still read it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import shared
from quern.streaming.requests import recover_jobs

#: Fixed value: jobs that are kept.
KEPT = 200
CURRENT = "current-"


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n[len(CURRENT) :]) for n in shared.names_in(spark, folder) if n.startswith(CURRENT))


def _pointer(folder: str, number: int) -> str:
    return f"{folder}/{CURRENT}{number:012d}"


def write(jobs: DataFrame, folder: str, inserted: str, keep: int = KEPT, derived: Sequence[str] = ()) -> None:
    """Make the last `keep` jobs by the column `inserted` the log, without fields that are derived from others."""
    spark, name = jobs.sparkSession, f"log-{shared.new_name()}"
    jobs.drop(*derived).orderBy(F.desc(inserted)).limit(keep).write.parquet(f"{folder}/{name}")
    number = max(_numbers(spark, folder), default=0) + 1
    while not shared.write_new(spark, _pointer(folder, number), name):
        number += 1
    for old in _numbers(spark, folder):
        if old < number - 1:
            shared.delete(spark, f"{folder}/{shared.read_text(spark, _pointer(folder, old))}")
            shared.delete(spark, _pointer(folder, old))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The log as it is after a restart: jobs that were in flight are interrupted. A folder without a log is an error."""
    numbers = _numbers(spark, folder)
    if not numbers:
        raise ValueError(f"no log of jobs: {folder}")
    return recover_jobs(spark.read.parquet(f"{folder}/{shared.read_text(spark, _pointer(folder, numbers[-1]))}"))
