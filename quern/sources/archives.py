"""Archives of a table as a data source: spark.read.format("quern-archive").load(path), df.write.format("quern-archive").save(path).

An archive is a ZIP file with metadata.json and members chunks.parquet/*.parquet. Tasks write archives of their own into a folder, and the
commit writes archives.json there, which lists them: a folder without it is no export, whatever lies in it. A path to read is such a folder or
one archive. The planner looks at the archives' directories alone and refuses members that aren't safe; members are read, and their
checksums compared, by the tasks. Nothing is unpacked to a disk and no rows pass the driver.
"""

from __future__ import annotations

import json
import os
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

NAME = "quern-archive"
TABLE, METADATA, LISTED = "chunks.parquet/", "metadata.json", "archives.json"
#: The bounds of one archive that is read.
MAX_MEMBERS, MAX_BYTES = 10_000, 10 << 30
MEMBER_BYTES = 64 << 20  # rows of a member that is written, in memory
ARCHIVE_MEMBERS = 64  # of an archive that is written
READ_BYTES = 128 << 20  # members that one task reads
STEP = 1 << 20


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/"):
        path = "/" + path[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _read(files: pafs.FileSystem, at: str) -> bytes:
    with files.open_input_file(at) as f:
        return f.read()


def check_members(archive: zipfile.ZipFile) -> None:
    """Bounds, no absolute or climbing paths, no links."""
    members = archive.infolist()
    if len(members) > MAX_MEMBERS or sum(m.file_size for m in members) > MAX_BYTES:
        raise ValueError("archive too large")
    for m in members:
        parts = m.filename.replace("\\", "/").split("/")
        if m.filename.startswith(("/", "\\")) or ".." in parts or ":" in parts[0] or (m.external_attr >> 16) & 0o170000 == 0o120000:
            raise ValueError(f"unsafe member {m.filename}")


def _wrapping(names: list[str]) -> str:
    """The one folder that all members may lie in."""
    first = names[0].split("/")[0] + "/" if names else ""
    return first if first != TABLE and all(n.startswith(first) for n in names) else ""


def _directory(files: pafs.FileSystem, at: str) -> tuple[list[tuple[str, int]], dict]:
    """(name, bytes) of an archive's table members, and its metadata."""
    try:
        with files.open_input_file(at) as f, zipfile.ZipFile(f) as z:
            check_members(z)
            names = [n for n in z.namelist() if not n.endswith("/")]
            wrap = _wrapping(names)
            metadata = json.loads(z.read(wrap + METADATA)) if wrap + METADATA in names else {}
            return [(n, z.getinfo(n).file_size) for n in names if n.startswith(wrap + TABLE)], metadata
    except (zipfile.BadZipFile, pa.ArrowInvalid) as e:
        raise ValueError(f"not a ZIP archive: {at}") from e


def _archives(files: pafs.FileSystem, at: str) -> list[str]:
    if files.get_file_info(at).type != pafs.FileType.Directory:
        return [at]
    if files.get_file_info(f"{at}/{LISTED}").type != pafs.FileType.File:
        raise ValueError(f"no export, or one that wasn't finished: {at}")
    listed = [x["name"] for x in json.loads(_read(files, f"{at}/{LISTED}"))["archives"]]
    if any("/" in n or "\\" in n for n in listed):
        raise ValueError("an export lists archives of its own folder only")
    return [f"{at}/{n}" for n in listed]


def directory(path: str) -> tuple[list[tuple[str, str, int]], dict]:
    """(archive, member, bytes) of the table members under a path and the metadata, {} if there is none. Only directories of archives are
    read; what isn't safe is a ValueError."""
    files, at = _place(path)
    if files.get_file_info(at).type == pafs.FileType.NotFound:
        raise ValueError(f"no archive: {path}")
    archives = _archives(files, at)
    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(lambda a: _directory(files, a), archives))
    metadata = json.loads(_read(files, f"{at}/{LISTED}"))["metadata"] if archives != [at] else found[0][1]
    return [(a, name, size) for a, (members, _) in zip(archives, found, strict=True) for name, size in members], metadata


@dataclass
class Members(InputPartition):
    """Members of one archive, which one task reads."""

    archive: str
    names: list[str]


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[Members]:
        out: list[Members] = []
        size = 0
        for archive, name, n in directory(self.path)[0]:
            if not out or out[-1].archive != archive or size + n > READ_BYTES:
                out.append(Members(archive, []))
                size = 0
            out[-1].names.append(name)
            size += n
        return out

    def read(self, partition: Members | None) -> Iterator[pa.RecordBatch]:
        if partition is None or not partition.names:
            return
        files, wanted = _place(self.path)[0], to_arrow_schema(self.schema)
        with files.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z:
            for name in partition.names:
                with z.open(name) as whole:  # reading to the end compares the checksum, which jumps about in a member don't
                    while whole.read(STEP):
                        pass
                with z.open(name) as member, pq.ParquetFile(pa.PythonFile(member, mode="r")) as rows:
                    held = set(rows.schema_arrow.names)
                    for batch in rows.iter_batches(10_000, columns=[c for c in wanted.names if c in held]):
                        arrays = [batch.column(c.name).cast(c.type) if c.name in held else pa.nulls(len(batch), c.type) for c in wanted]
                        yield pa.RecordBatch.from_arrays(arrays, schema=wanted)


@dataclass
class Written(WriterCommitMessage):
    """The archives that a task has written."""

    archives: list[dict]


def _groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    group: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if group and held + batch.nbytes > size:
            yield group
            group, held = [], 0
        group.append(batch)
        held += batch.nbytes
    if group:
        yield group


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, member_bytes: int, metadata: dict):
        self.path, self.schema, self.overwrite, self.member_bytes, self.metadata = path, schema, overwrite, member_bytes, metadata
        self.run = uuid.uuid4().hex
        files, at = _place(path)
        kind = files.get_file_info(at).type
        if kind == pafs.FileType.File or not overwrite and files.get_file_info(f"{at}/{LISTED}").type == pafs.FileType.File:
            raise ValueError(f"an export is there: {path}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, at = _place(self.path)
        files.create_dir(at, recursive=True)
        schema, task, out = to_arrow_schema(self.schema), f"part-{self.run}-{TaskContext.get().partitionId()}-{uuid.uuid4().hex[:8]}", []
        groups = _groups(iterator, self.member_bytes)
        group = next(groups, None)
        while group is not None:
            name, rows, members = f"{task}-{len(out)}.zip", 0, 0
            with files.open_output_stream(f"{at}/{name}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:  # Parquet is compressed already
                z.writestr(METADATA, json.dumps(self.metadata))
                while group is not None and members < ARCHIVE_MEMBERS:
                    with z.open(f"{TABLE}{members}.parquet", "w", force_zip64=True) as member, pq.ParquetWriter(member, schema) as writer:
                        for batch in group:
                            writer.write_batch(batch.cast(schema))
                            rows += len(batch)
                    members += 1
                    group = next(groups, None)
            out.append({"name": name, "members": members, "rows": rows})
        return Written(out)

    def _clear(self, keep: set[str], mine: bool) -> None:
        """Delete this run's archives, or all others, that aren't to be kept."""
        files, at = _place(self.path)
        for info in files.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
            if info.base_name.startswith("part-") and info.base_name not in keep and (not mine or info.base_name.startswith(f"part-{self.run}-")):
                files.delete_file(info.path)

    def commit(self, messages: list[Written | None]) -> None:
        files, at = _place(self.path)
        files.create_dir(at, recursive=True)
        archives = [a for m in messages if m for a in m.archives]
        if not archives:  # the columns of a table without rows
            archives = [{"name": f"part-{self.run}-empty.zip", "members": 1, "rows": 0}]
            with files.open_output_stream(f"{at}/{archives[0]['name']}") as f, zipfile.ZipFile(f, "w") as z:
                z.writestr(METADATA, json.dumps(self.metadata))
                with z.open(f"{TABLE}0.parquet", "w") as member:
                    pq.ParquetWriter(member, to_arrow_schema(self.schema)).close()
        staged = f"{at}/{LISTED}.{self.run}"
        with files.open_output_stream(staged) as f:
            f.write(json.dumps({"metadata": self.metadata, "archives": archives}).encode())
        files.move(staged, f"{at}/{LISTED}")
        self._clear({a["name"] for a in archives}, mine=not self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(set(), mine=True)


class ArchiveSource(DataSource):
    """Options of a write: memberBytes, and metadata, a JSON object that every archive gets."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        members, _ = directory(self.options["path"])
        if not members:
            raise ValueError("archive has no chunk table")
        archive, name, _ = members[0]
        with _place(self.options["path"])[0].open_input_file(archive) as f, zipfile.ZipFile(f) as z, z.open(name) as member:
            return from_arrow_schema(pq.read_schema(pa.PythonFile(member, mode="r")))

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], schema, overwrite, int(self.options.get("memberBytes", MEMBER_BYTES)), json.loads(self.options.get("metadata", "{}")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
