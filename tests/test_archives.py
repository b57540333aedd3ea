"""Archives as a data source: exports by tasks, imports by members, and what is refused."""

import io
import json
import os
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.schema import CHUNK_SCHEMA
from quern.sources import archives
from quern.sources.store import ChunkStore, import_archive


@pytest.fixture(scope="module")
def source(spark):
    archives.register(spark)
    return spark


def frame(spark, n, dimension=2):
    vector = F.array(*[(F.col("id") * (k + 1)).cast("float") for k in range(dimension)])
    texts = [F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("tè 漢 "), F.col("id").cast("string"))).alias("text")]
    rest = [F.lit("x").alias(c) for c in CHUNK_SCHEMA.fieldNames()[3:]]
    return spark.range(n).repartition(3).select(F.format_string("c%05d", "id").alias("chunk_id"), *texts, vector.alias("vector"), *rest)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*CHUNK_SCHEMA.fieldNames()).collect())


def parquet_bytes(**columns):
    out = io.BytesIO()
    pq.write_table(pa.table(columns), out)
    return out.getvalue()


def zipped(path, members, kind=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", kind) as z:
        for name, content in members.items():
            z.writestr(name, content)
    return str(path)


def test_round_trip_in_many_members(source, tmp_path):
    made, path = frame(source, 75_000), str(tmp_path / "out")
    made.write.format(archives.NAME).option("memberBytes", 200_000).option("metadata", json.dumps({"a": 1})).mode("append").save(path)
    members, metadata = archives.directory(path)
    assert metadata == {"a": 1} and len({a for a, _, _ in members}) == 3 and len(members) > 6
    back = source.read.format(archives.NAME).load(path)
    assert back.rdd.getNumPartitions() == 3 and rows_of(back) == rows_of(made)
    listed = json.loads((tmp_path / "out" / archives.LISTED).read_text())["archives"]
    assert sum(a["rows"] for a in listed) == 75_000
    one = os.path.join(path, listed[0]["name"])  # each archive can be read alone
    assert source.read.format(archives.NAME).load(one).count() == listed[0]["rows"] and archives.directory(one)[1] == {"a": 1}
    narrow = source.read.format(archives.NAME).schema("chunk_id string, extra int").load(path)  # columns that aren't there are null
    assert narrow.where("extra is not null").count() == 0 and narrow.select("chunk_id").distinct().count() == 75_000


def test_commit_and_abort(source, tmp_path):
    path = str(tmp_path / "out")
    write = lambda df, mode: df.write.format(archives.NAME).mode(mode).save(path)
    broken = frame(source, 100).withColumn("text", F.when(F.col("chunk_id") == "c00050", F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        write(broken, "append")
    assert [n for n in os.listdir(path) if n.endswith(".zip")] == [] and archives.LISTED not in os.listdir(path)
    with pytest.raises(ValueError, match="finished"):
        archives.directory(path)
    write(frame(source, 50), "append")
    with pytest.raises(Exception, match="an export is there"):
        write(frame(source, 60), "append")
    with pytest.raises(Exception, match="broken"):
        write(broken, "overwrite")
    assert rows_of(source.read.format(archives.NAME).load(path)) == rows_of(frame(source, 50))  # a failed overwrite changes nothing
    write(frame(source, 60), "overwrite")
    assert source.read.format(archives.NAME).load(path).count() == 60
    assert len([n for n in os.listdir(path) if n.endswith(".zip")]) == 3  # the archives before are gone
    write(frame(source, 0), "overwrite")
    none = source.read.format(archives.NAME).load(path)
    assert none.count() == 0 and none.columns == CHUNK_SCHEMA.fieldNames()


def test_store_export_and_import(source, tmp_path):
    store = ChunkStore(source, str(tmp_path / "store"), 2)
    store.upsert(frame(source, 300))
    store.export(str(tmp_path / "x"), "model")
    metadata = import_archive(source, str(tmp_path / "x"), str(tmp_path / "copy"))
    assert metadata["embeddingModel"] == "model" and metadata["dimension"] == 2
    assert rows_of(ChunkStore(source, str(tmp_path / "copy"), 2).read()) == rows_of(store.read())
    assert sorted(os.listdir(tmp_path)) == ["copy", "store", "x"]  # no stage is left


def test_foreign_archives(source, tmp_path):
    table = parquet_bytes(chunk_id=["a", "b"], vector=[[1.0, 2.0], [3.0, 4.0]], more=[1, 2])
    whole = zipped(tmp_path / "wrapped.zip", {"folder/chunks.parquet/0.parquet": table, "folder/notes.txt": b"n"})
    metadata = import_archive(source, whole, str(tmp_path / "one"))
    assert metadata == {"format": "imported", "embeddingModel": "unknown", "dimension": 2}
    got = ChunkStore(source, str(tmp_path / "one"), 2).read().select("chunk_id", "vector", "text").orderBy("chunk_id").collect()
    assert [tuple(r) for r in got] == [("a", [1.0, 2.0], None), ("b", [3.0, 4.0], None)]
    other = zipped(tmp_path / "other.zip", {"metadata.json": json.dumps({"dimension": 3}), "chunks.parquet/0.parquet": table})
    with pytest.raises(ValueError, match="dimension"):
        import_archive(source, other, str(tmp_path / "two"))
    assert not os.path.exists(tmp_path / "two")


@pytest.mark.parametrize("name", ["../../evil.parquet", "/etc/x", "a/../../b", "C:/x", "..\\x"])
def test_unsafe_members_are_refused_by_the_planner(source, tmp_path, name):
    table = parquet_bytes(chunk_id=["a"], vector=[[1.0]])
    bad = zipped(tmp_path / "bad.zip", {"chunks.parquet/0.parquet": table, name: b"x"})
    with pytest.raises(Exception, match="unsafe member"):
        source.read.format(archives.NAME).load(bad)
    with pytest.raises(Exception, match="unsafe member"):  # with a schema the members are looked at when partitions are planned
        source.read.format(archives.NAME).schema("chunk_id string").load(bad).count()
    with pytest.raises(ValueError, match="unsafe member"):
        import_archive(source, bad, str(tmp_path / "new"))
    assert not os.path.exists(tmp_path / "new")


def test_links_crowds_and_damage(source, tmp_path, monkeypatch):
    table = parquet_bytes(chunk_id=["a"], vector=[[1.0]])
    link = zipfile.ZipInfo("chunks.parquet/link")
    link.external_attr = 0o120777 << 16
    linked = str(tmp_path / "link.zip")
    with zipfile.ZipFile(linked, "w") as z:
        z.writestr("chunks.parquet/0.parquet", table)
        z.writestr(link, "/etc/passwd")
    with pytest.raises(ValueError, match="unsafe"):
        archives.directory(linked)
    with pytest.raises(ValueError, match="not a ZIP"):
        archives.directory(str((tmp_path / "text").write_text("x") and tmp_path / "text"))
    with pytest.raises(ValueError, match="no archive"):
        archives.directory(str(tmp_path / "nothing"))
    with pytest.raises(ValueError, match="no chunk table"):
        import_archive(source, zipped(tmp_path / "none.zip", {"readme.txt": b"x"}), str(tmp_path / "new"))
    whole = zipped(tmp_path / "whole.zip", {"chunks.parquet/0.parquet": table}, zipfile.ZIP_STORED)
    content = bytearray(open(whole, "rb").read())
    content[content.index(b"PAR1") + 8] ^= 255
    damaged = str(tmp_path / "damaged.zip")
    with open(damaged, "wb") as f:
        f.write(content)
    with pytest.raises(Exception, match="CRC"):
        source.read.format(archives.NAME).load(damaged).count()
    with pytest.raises(Exception, match="CRC"):
        import_archive(source, damaged, str(tmp_path / "new"))
    assert not os.path.exists(tmp_path / "new")
    monkeypatch.setattr(archives, "MAX_MEMBERS", 0)
    with pytest.raises(ValueError, match="too large"):
        archives.directory(whole)
