"""Filters, search, pages, samples, inventory and library statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from quern.functions import scalars as S
from quern.operators.skew import join_in_parts
from quern.sources.shared import settled

MOST_IDS = 10_000  # ids of a list that are written into the plan
#: How many jobs and notifications a view shows.
SHOWN_JOBS, SHOWN_NOTIFICATIONS = 8, 20
GRAM = 3  # characters of the pieces by which names are looked for
RANGE_ROWS = 100_000  # rows of a range of a paged table


def filter_equal(df: DataFrame, **values: str | None) -> DataFrame:
    """Rows that equal every value given; None and '' mean not set. Plain equalities, so that they reach the scan."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])) if kv[1] else d, values.items(), df)


def filter_choice(df: DataFrame, column: str, choice: str) -> DataFrame:
    """'all' keeps every row."""
    return df if choice == "all" else df.where(F.col(column) == choice)


def search(df: DataFrame, term: str, *columns: str) -> DataFrame:
    """Rows in one of whose columns the stripped term occurs, whatever the case; an empty term keeps all. No wildcards."""
    term = term.strip().lower()
    return df.where(reduce(lambda a, b: a | b, [F.contains(F.lower(S.text_of(F.col(c).cast("string"))), F.lit(term)) for c in columns])) if term else df


def fetch_in_order(df: DataFrame, ids: list, id_col: str) -> DataFrame:
    """Rows of the ids, in the order of the list; ids that aren't there are left out."""
    wanted = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(ids)], f"{id_col} {df.schema[id_col].dataType.simpleString()}, rank int")
    if len(ids) > MOST_IDS:
        return df.join(wanted, id_col).orderBy("rank")
    return df.where(F.col(id_col).isin(ids)).join(F.broadcast(wanted), id_col).orderBy("rank")


def page(df: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    """One page (from 1) with chunk_num counted over all pages."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page must be at least 1, size within 1..100")
    begin = (number - 1) * size
    rows = df.orderBy(*order).offset(begin).limit(size)
    return rows.withColumn("chunk_num", F.row_number().over(W.Window.orderBy(*order)) + begin)


class PagedRows:
    """Rows in a total order, written in ranges of it with the number of rows of each: a page reads the ranges that hold it."""

    def __init__(self, spark: SparkSession, folder: str, order: list[str]):
        self.spark, self.folder, self.order = spark, folder, order
        self.schema = spark.read.parquet(f"{folder}/schema").schema
        self.counts = {r.range: r.n for r in spark.read.parquet(f"{folder}/counts").orderBy("range").collect()}  # a row for each range

    @classmethod
    def write(cls, df: DataFrame, folder: str, *order: str, rows: int = RANGE_ROWS) -> PagedRows:
        """rows: of a range, about. The columns of df may not be called range."""
        ranges = max(1, -(-df.count() // rows))
        ranged = df.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()).sortWithinPartitions(*order)
        ranged.write.partitionBy("range").parquet(f"{folder}/rows")
        df.sparkSession.createDataFrame([], T.StructType([*df.schema.fields, T.StructField("range", T.IntegerType())])).write.parquet(f"{folder}/schema")
        schema = T.StructType([df.schema[order[0]], T.StructField("range", T.IntegerType())])
        df.sparkSession.read.schema(schema).parquet(f"{folder}/rows").groupBy("range").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{folder}/counts")
        return cls(df.sparkSession, folder, list(order))

    def total(self) -> int:
        return sum(self.counts.values())

    def page(self, number: int, size: int) -> DataFrame:
        """One page (from 1) with chunk_num counted over all pages; beyond the last one no rows."""
        if number < 1 or not 1 <= size <= 100:
            raise ValueError("page must be at least 1, size within 1..100")
        begin, before, held = (number - 1) * size, 0, []
        for r, n in self.counts.items():
            if before < begin + size and before + n > begin:
                held.append((r, before))
            before += n
        rows = self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows").where(F.col("range").isin([r for r, _ in held]))
        place = F.row_number().over(W.Window.orderBy(*self.order)) + F.lit(held[0][1] if held else 0)
        return rows.withColumn("chunk_num", place).where(F.col("chunk_num").between(begin + 1, begin + size)).drop("range").orderBy("chunk_num")


def sample(df: DataFrame, size: int = 500, *order: str) -> DataFrame:
    """The first rows of a fixed order, as a repeatable sample."""
    if not 1 <= size <= 1000:
        raise ValueError("size within 1..1000")
    return df.orderBy(*order).limit(size)


def batch_number(df: DataFrame, order: str, size: int = 32) -> DataFrame:
    """df with place (from 1) and batch (from 0, size rows each) in order of a column, ties by a hash of the row.

    Rows are dealt to ranges of the order, and that dealing is written down: places come from each range's own order and from the counts
    of the ranges before it, so both must see the same ranges. No range grows with the ties of a value. Counts are one row a partition.
    """
    ties = F.xxhash64(*df.columns)
    ranged = settled(df.withColumn("_t", ties).repartitionByRange(order, "_t").withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("n"))
    before = counts.select("_p", (F.sum("n").over(W.Window.orderBy("_p")) - F.col("n")).alias("_before"))
    place = F.row_number().over(W.Window.partitionBy("_p").orderBy(order, "_t")) + F.col("_before")
    numbered = ranged.join(F.broadcast(before), "_p").withColumn("place", place).drop("_p", "_t", "_before")
    return numbered.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("int"))


def inventory(chunks: DataFrame, database: str) -> DataFrame:
    """Documents of a chunk table (source_path, source_title, section): one row a path, or a title where the path is empty."""
    key = F.when(S.text_of("source_path") != "", F.col("source_path")).otherwise(S.text_of("source_title"))
    docs = chunks.withColumn("doc_key", key).groupBy("doc_key").agg(F.count("*").alias("chunks"), F.countDistinct(F.nullif(F.col("section"), F.lit(""))).alias("sections"), F.min("source_title").alias("title"))
    return docs.select(S.name_uuid(F.concat(F.lit(f"{database}::"), "doc_key")).alias("doc_uuid"), "doc_key", "title", S.doc_type(F.col("doc_key")).alias("doc_type"), "chunks", "sections")


def library_stats(chunks: DataFrame, databases: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Chunks and documents; with `databases`, their number; with `stored`, a table read from files, the bytes of those files."""
    key = F.when(S.text_of("source_path") != "", F.col("source_path")).otherwise(S.text_of("source_title"))
    out = chunks.agg(F.count("*").alias("chunks"), F.countDistinct(key).alias("documents"))
    if databases is not None:
        out = out.withColumn("databases", F.lit(databases))
    if stored is not None:
        out = out.join(storage_bytes(stored))  # one row each
    return out


def storage_bytes(stored: DataFrame) -> DataFrame:
    """The bytes of the files that a table is read from, each file once."""
    files = stored.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).distinct()
    return files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("storage_bytes"))


def active_jobs(jobs: DataFrame) -> DataFrame:
    """How many jobs wait or run."""
    return jobs.where(F.col("status").isin("pending", "in_progress")).agg(F.count("*").alias("active"))


def download(chunks: DataFrame) -> DataFrame:
    """chunks (chunk_num, doc_title, ...): a file name and the row as JSON for each."""
    name = F.concat(F.lit("chunk_"), F.col("chunk_num").cast("string"), F.lit("_"), S.file_name(F.col("doc_title")), F.lit(".json"))
    return chunks.select(name.alias("name"), F.to_json(F.struct(*chunks.columns)).alias("content"))


def ordered_distinct(df: DataFrame, group: str, value: str, rank: str) -> DataFrame:
    """For each group its distinct values by their first rank, joined by ' | '; values of a group are a ranking's few."""
    firsts = df.groupBy(group, value).agg(F.min(rank).alias("first"))
    return firsts.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", value))), lambda x: x[value]), " | ").alias("titles"))


def latest(df: DataFrame, key: str, *by: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("row")).select(key, "row.*")


def newest(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The last n rows by some columns, last first."""
    if n < 1:
        raise ValueError("one row at least")
    return df.orderBy(*map(F.desc, by)).limit(n)


def tail_then_sort(df: DataFrame, keep: int, inserted: str, shown: str) -> DataFrame:
    """The last `keep` rows by insertion, and only then sorted by another column, newest first."""
    return df.orderBy(F.desc(inserted)).limit(keep).orderBy(F.desc(shown), F.desc(inserted))


def _grams(text: Column) -> Column:
    """The distinct pieces of GRAM characters of a text, and those of fewer."""
    none = F.expr("cast(array() as array<string>)")

    def pieces(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, found).otherwise(none)

    return F.array_distinct(F.concat(*map(pieces, range(1, GRAM + 1))))


def exists_containing(cases: DataFrame, docs: DataFrame, expected: str, path: str) -> DataFrame:
    """cases with a column found: does any document's path contain the expected name?

    Both sides may have any number of rows: a name is looked for where its rarest piece of GRAM characters stands (a shorter name is a piece
    itself), and compared with those paths alone. Every path contains the empty name; null names and null paths match nothing.
    """
    names = cases.where(F.col(expected).isNotNull()).select(F.col(expected).alias("name")).distinct()
    paths = docs.where(F.col(path).isNotNull()).select(F.col(path).alias("path")).distinct()
    whole = F.greatest(F.least(F.length("name"), F.lit(GRAM)), F.lit(1))
    asked = names.select("name", F.explode(F.filter(_grams(F.col("name")), lambda g: F.length(g) == whole)).alias("gram"))
    held = settled(paths.select("path", F.explode(_grams(F.col("path"))).alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi"))
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    # a name with a piece that no path has is in none
    rarest = asked.join(counts, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).where("least.n > 0").select("name", "least.gram")
    sought = settled(rarest.join(counts, "gram").groupBy("gram", "n").agg(F.collect_list("name").alias("names")))
    hits = join_in_parts(held, sought, "gram").select("path", F.explode("names").alias("name")).where(F.contains("path", F.col("name"))).select("name").distinct()
    if paths.limit(1).count():
        hits = hits.unionByName(names.where("name = ''"))
    return cases.join(hits.withColumn("found", F.lit(True)), F.col(expected) == F.col("name"), "left").withColumn("found", F.coalesce("found", F.lit(False))).drop("name")


def changes(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before in their key's order; the first row is a change."""
    before = F.lag(value).over(W.Window.partitionBy(key).orderBy(order))
    first = F.row_number().over(W.Window.partitionBy(key).orderBy(order)) == 1
    return df.withColumn("changed", first | ~before.eqNullSafe(F.col(value))).where("changed").drop("changed")


def scale(value: Column, low: Column, high: Column) -> Column:
    """A coordinate on the map, 15 to 85."""
    return F.round((value - low) / (high - low + 1e-6) * 70 + 15, 2)
