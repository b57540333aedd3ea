"""File sources: unit files, admission of uploads, and a hook for document converters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quern.functions import scalars as S
from quern.operators.chunking import chunk_sections, section_items

#: A file name that is never ingested, and ceilings of one request.
EXCLUDED = ["Calculus PDF.json"]
MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES = 500, 250 << 20, 2 << 30
SUFFIXES = ["json", "pdf"]


def unit_files(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of all unit files under a folder: JSON arrays of {titolo, testo}. A file that isn't a list fails the job."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("wholetext", "true").text(folder)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value")).where(~S.base_name(F.url_decode("path")).isin(EXCLUDED))
    checked = F.when(F.json_array_length("value").isNull(), F.raise_error(F.concat(F.lit("not a list: "), "path")).cast("string")).otherwise(F.col("value"))
    units = rows.select("path", F.posexplode(F.from_json(checked, "array<struct<titolo:string,testo:string>>")).alias("unit_num", "unit"))
    out = units.select(F.url_decode("path").alias("source_path"), S.title_of(F.url_decode("path")).alias("source_title"), F.lit("libro").alias("source_type"), F.lit("it").alias("language"), "unit_num", S.text_of("unit.titolo").alias("section"), F.lit("").alias("position"), S.text_of("unit.testo").alias("text"), F.expr("cast(array() as array<string>)").alias("tables"))
    return out.where(S.strip(F.col("text")) != "")


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of the PDF files right in a folder, in order of their paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select(F.url_decode("path").alias("path"), "content").orderBy("path")


def unit_chunks(spark: SparkSession, folder: str, target_tokens: int = 600, overlap_ratio: float = 0.12) -> DataFrame:
    """Chunks of all unit files under a folder, with file_num, unit_num and chunk_num: their order by path, place and packing."""
    units = unit_files(spark, folder)
    chunks = chunk_sections(units.withColumn("position", F.col("unit_num").cast("string")), target_tokens, overlap_ratio)
    numbers = units.select("source_path").distinct().withColumn("file_num", F.dense_rank().over(W.Window.orderBy("source_path")) - 1)
    key = S.chunk_id(*map(F.col, ("source_path", "source_title", "section")), F.lit(""), F.col("text"))
    placed = chunks.withColumn("unit_num", F.col("position").cast("int")).withColumn("position", F.lit("")).withColumn("chunk_id", key)
    return placed.join(F.broadcast(numbers), "source_path")  # one row a file of a request


def pdf_chunks(files: DataFrame, converter: Callable[[bytes], list[dict]], title: str | None = None, source_type: str = "libro", target_tokens: int = 600, overlap_ratio: float = 0.12) -> DataFrame:
    """files (path, content): converted, sectioned and packed. title: instead of the one that the path gives."""
    sections = section_items(convert(files, converter))
    named = S.title_of(F.col("doc")) if title is None else F.lit(title)
    rows = sections.select(named.alias("source_title"), F.lit(source_type).alias("source_type"), F.col("doc").alias("source_path"), F.lit("it").alias("language"), F.col("title").alias("section"), "position", "text", "tables")
    return chunk_sections(rows, target_tokens, overlap_ratio)


def admitted(uploads: DataFrame, max_payload_bytes: int = MAX_TOTAL_BYTES) -> DataFrame:
    """uploads (name, bytes): clean_name, bytes, accepted; ceilings over the whole request raise in the job.

    Of accepted files with one clean name, all but the first by name and size get eight hex digits before their suffix.
    """
    total = uploads.agg(F.count("*").alias("n"), F.max("bytes").alias("most"), F.sum("bytes").alias("sum"))
    over = (F.col("n") > MAX_FILES) | (F.col("most") > MAX_FILE_BYTES) | (F.col("sum") > min(MAX_TOTAL_BYTES, max_payload_bytes))
    ok = total.select(F.when(over, F.raise_error(F.lit("request over its ceilings")).cast("boolean")).otherwise(F.lit(True)).alias("_ok"))
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    rows = uploads.join(F.broadcast(ok)).where("_ok").select("name", S.clean_path(F.col("name")).alias("clean"), "bytes", suffix.isin(SUFFIXES).alias("accepted"))
    nth = F.row_number().over(W.Window.partitionBy("clean", "accepted").orderBy("name", "bytes"))
    mark = F.substring(F.sha2(F.concat_ws("|", "name", "bytes", nth), 256), 1, 8)
    return rows.select(F.when(F.col("accepted") & (nth > 1), F.regexp_replace(F.col("clean"), F.lit(r"^(.*?)(\.[^./]*)?$"), F.concat(F.lit("$1_"), mark, F.lit("$2")))).otherwise(F.col("clean")).alias("clean_name"), "bytes", "accepted")


def request_sums(uploads: DataFrame, request: str, max_payload_bytes: int = MAX_TOTAL_BYTES) -> DataFrame:
    """uploads (a request, bytes): files, bytes and largest of each request, and whether it keeps the ceilings. Unknown sizes are 0."""
    n = F.coalesce("bytes", F.lit(0))
    sums = uploads.groupBy(request).agg(F.count("*").alias("files"), F.sum(n).alias("bytes"), F.max(n).alias("largest"))
    keeps = (F.col("files") <= MAX_FILES) & (F.col("largest") <= MAX_FILE_BYTES) & (F.col("bytes") <= min(MAX_TOTAL_BYTES, max_payload_bytes))
    return sums.withColumn("admitted", keeps)


def has_text_layer(pages: DataFrame, threshold: int = 200) -> DataFrame:
    """pages (doc, page, text): does the text of the first three pages reach the threshold?"""
    return pages.groupBy("doc").agg((F.coalesce(F.sum(F.when(F.col("page") <= 3, F.length(S.text_of("text")))), F.lit(0)) >= threshold).alias("has_text"))


def convert(files: DataFrame, converter: Callable[[bytes], list[dict]]) -> DataFrame:
    """files (path, content): the items that a converter makes of each file, for sectioning. The converter is loaded in the tasks."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                items = [{"doc": path, "seq": i, "text": None, "label": "text", "level": 1, "page_no": 0, "table_md": None} | x for i, x in enumerate(converter(content))]
                yield pd.DataFrame(items, columns=["doc", "seq", "text", "label", "level", "page_no", "table_md"])

    return files.select("path", "content").mapInPandas(run, "doc string, seq long, text string, label string, level int, page_no int, table_md string")
