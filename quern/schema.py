"""The stored relation: one table of chunks."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNK_SCHEMA = T.StructType([
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("text", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType(), False)),
    T.StructField("source_title", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("position", T.StringType()),
    T.StructField("source_path", T.StringType()),
    T.StructField("language", T.StringType()),
])

#: Source types as stored, and the label that the view shows for each.
SOURCE_TYPES = {"libro": "Libro", "articolo": "Ricerca", "video": "Manuale"}
SECTION_SCHEMA = "title string, text string, position string, tables array<string>"
