"""The bucketed table: what an upsert rewrites, writers that meet, versions."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources import buckets, shared
from quern.sources.buckets import BucketedTable

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.LongType())])
NUMBERS = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.LongType())])


def rows(spark, pairs, schema=SCHEMA):
    return spark.createDataFrame(pairs, schema)


def content(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, "id", buckets=128)
    everything = {f"k{i:05d}": i for i in range(8000)}
    assert table.upsert(rows(spark, list(everything.items()))) == 8000 and table.count() == 8000
    before = set(table.files())
    assert len(before) == 128
    few = {k: -1 for k in random.Random(1).sample(sorted(everything), 80)}  # 1 % of the keys
    hit = rows(spark, [(k, 0) for k in few]).select(F.pmod(F.xxhash64("id"), F.lit(128)).alias("b")).distinct().count()
    assert hit < 80
    table.upsert(rows(spark, list(few.items())))
    after = set(table.files())
    assert len(before - after) == len(after - before) == hit  # these were rewritten, the others stay as they are
    assert content(table) == sorted((everything | few).items()) and table.count() == 8000


def test_rows_beyond_all_ranges_rewrite_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "BUCKET_FILES", 3)
    table = BucketedTable(spark, str(tmp_path / "t"), NUMBERS, "id", buckets=2)
    want = {}
    for step in range(5):
        new = {step * 100 + i: step for i in range(40)}
        before = set(table.files())
        table.upsert(rows(spark, list(new.items()), NUMBERS))
        want |= new
        rewritten = before - set(table.files())
        # two more files a time, until a bucket has three, which become one
        assert len(rewritten) == (6 if step == 3 else 0) and len(table.files()) == (2, 4, 6, 2, 4)[step]
        assert content(table) == sorted(want.items())
    table.upsert(rows(spark, [(5, 99)], NUMBERS))  # inside one file's range
    assert content(table) == sorted((want | {5: 99}).items())


def test_buckets_double(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), NUMBERS, "id", buckets=1, bucket_rows=50)
    for step in range(4):
        table.upsert(rows(spark, [(step * 60 + i, step) for i in range(60)], NUMBERS))
    assert table.count() == 240 and len({f.bucket for f in table.files()}) == 8
    again = BucketedTable(spark, str(tmp_path / "t"), NUMBERS, "id", buckets=1, bucket_rows=50)  # the number is the table's
    again.upsert(rows(spark, [(7, -7)], NUMBERS))
    assert dict(content(again))[7] == -7 and again.count() == 240


def test_nulls_repeats_and_nothing(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, "id")
    assert table.read().count() == 0 and table.count() == 0 and table.upsert(rows(spark, [])) == 0
    table.upsert(rows(spark, [("", None), ("b", 2)]))
    with pytest.raises(Exception, match="null key"):
        table.upsert(rows(spark, [(None, 1)]))
    with pytest.raises(Exception, match="no order"):
        table.upsert(rows(spark, [("c", 1), ("c", 2)]))
    table.upsert(rows(spark, [("b", 1), ("b", 2)]).withColumn("w", F.col("v")).withColumn("bucket_of", F.lit("x")).drop("bucket_of"), "w")
    assert content(table) == [("", None), ("b", 2)]
    assert not [n for n in shared.names_in(spark, table.folder) if n.startswith("incoming")]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    """Another writer commits between this one's reading and its commit: this one begins again from what the other wrote."""
    one, other = (BucketedTable(spark, str(tmp_path / "t"), NUMBERS, "id", buckets=4) for _ in range(2))
    one.upsert(rows(spark, [(i, 0) for i in range(20)], NUMBERS))
    plain, meddled = one.log.publish, []

    def publish(*args):
        if not meddled:
            meddled.append(True)
            other.upsert(rows(spark, [(3, 33), (100, 1)], NUMBERS))
        return plain(*args)

    monkeypatch.setattr(one.log, "publish", publish)
    one.upsert(rows(spark, [(4, 44)], NUMBERS))
    assert content(one) == sorted(({i: 0 for i in range(20)} | {3: 33, 100: 1, 4: 44}).items())
    monkeypatch.setattr(one.log, "publish", lambda *args: False)
    with pytest.raises(buckets.Conflict):
        one.upsert(rows(spark, [(4, 45)], NUMBERS))
    assert dict(content(other))[4] == 44


def test_the_version_before_stays_readable(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), NUMBERS, "id", buckets=2)
    table.upsert(rows(spark, [(i, 0) for i in range(10)], NUMBERS))
    reader = table.read()
    table.upsert(rows(spark, [(i, 1) for i in range(10)], NUMBERS))
    assert {r.v for r in reader.collect()} == {0}
    table.upsert(rows(spark, [(i, 2) for i in range(10)], NUMBERS))
    assert {r.v for r in table.read().collect()} == {2} and len(table.log.numbers()) == 2
    shared.write_new(spark, f"{table.folder}/v{table.log.last() + 1:08d}", "")  # a writer that was lost before it wrote the name
    assert {r.v for r in table.read().collect()} == {2}


def test_what_lost_writers_left_is_cleaned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "ATTEMPTS", 2)
    table = BucketedTable(spark, str(tmp_path / "t"), NUMBERS, "id", buckets=2)
    table.upsert(rows(spark, [(1, 1)], NUMBERS))
    rows(spark, [(9, 9)], NUMBERS).write.parquet(f"{table.folder}/data/lost")
    shared.write_new(spark, f"{table.folder}/v{table.log.last() + 1:08d}", "")
    with pytest.raises(buckets.Conflict):  # it may still be at work
        table.upsert(rows(spark, [(2, 2)], NUMBERS))
    table.clean()
    assert shared.names_in(spark, f"{table.folder}/data") == [table.files()[0].written] and content(table) == [(1, 1)]
    table.upsert(rows(spark, [(2, 2)], NUMBERS))
    assert content(table) == [(1, 1), (2, 2)]
