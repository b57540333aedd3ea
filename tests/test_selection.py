"""Places in groups without sorting them, names in paths by their pieces, pages by ranges."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import evaluation, listing


@pytest.mark.parametrize("few", [evaluation.FEW, 20])
def test_p95_agrees_with_sorting(spark, few):
    rng = random.Random(1)
    groups = {"spread": [10 ** rng.uniform(-9, 9) for _ in range(3000)], "ties": [1.0] * 2000 + [2.0] * 90 + [5.0] * 20, "one": [3.5], "zero": [0.0] * 50 + [7.0], "negative": [rng.uniform(-5, 0) for _ in range(700)], "two": [1.0, 2.0]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("spread", None), (None, 4.0)]
    frame = spark.createDataFrame(rows, "phase string, seconds double").repartition(5)
    got = {r.phase: (r.p95, r.n) for r in evaluation.p95(frame, "phase", "seconds", few=few).collect() if r.phase}
    assert got == {g: (sorted(v)[int(len(v) * 0.95)], len(v)) for g, v in groups.items()}
    shown = {r.phase: r.p95 for r in evaluation.p95(frame.where("phase = 'zero'"), "phase", "seconds", zero_is_missing=True, few=few).collect()}
    assert shown == {"zero": 7.0} and evaluation.p95(frame.limit(0), "phase", "seconds", few=few).count() == 0


def test_names_in_paths(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdé/.%_") for _ in range(n))
    paths = [word(rng.randrange(0, 30)) for _ in range(300)] + [None, ""]
    names = [word(rng.randrange(0, 7)) for _ in range(400)] + [rng.choice(paths[:300])[2:9] for _ in range(200)] + [None, "", "x", "a%"]
    cases = spark.createDataFrame(list(enumerate(names)), "case_id long, expected string")
    docs = spark.createDataFrame([(p, "clash") for p in paths], "path string, gram string")
    got = {r.case_id: r.found for r in listing.exists_containing(cases, docs, "expected", "path").collect()}
    assert got == {i: n is not None and any(p is not None and n in p for p in paths) for i, n in enumerate(names)}
    assert not any(r.found for r in listing.exists_containing(cases, docs.limit(0), "expected", "path").collect())


def test_pages_read_the_ranges_that_hold_them(spark, tmp_path):
    frame = spark.range(30_000).select(((F.col("id") * 7919) % 30_000).alias("id"), F.lit("x").alias("v"))
    rows = listing.PagedRows.write(frame, str(tmp_path / "p"), "id", rows=1000)
    assert rows.total() == 30_000 and len(rows.counts) > 20
    last = rows.page(300, 100)
    assert [(r.id, r.chunk_num) for r in last.collect()] == [(29_900 + i, 29_901 + i) for i in range(100)]
    assert last._jdf.queryExecution().executedPlan().toString().count("range") > 0 and rows.page(301, 100).count() == 0
    scanned = spark.read.parquet(str(tmp_path / "p/rows")).where(F.col("range") == max(rows.counts)).count()
    assert scanned < 3000  # what the last page reads of 30,000
    for number in (1, 17, 123):  # ones over two ranges too
        assert [r.id for r in rows.page(number, 77).collect()] == list(range((number - 1) * 77, number * 77))
    none = listing.PagedRows.write(frame.limit(0), str(tmp_path / "none"), "id")
    assert none.total() == 0 and none.page(1, 10).count() == 0
    with pytest.raises(ValueError):
        rows.page(0, 10)
