"""Sentence packing with overlap, and sectioning of document items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quern.functions import scalars as S


def budget(target_tokens: int, overlap_ratio: float) -> tuple[int, int]:
    """Words of a chunk, and of its overlap."""
    words = int(target_tokens / 1.3)
    return words, int(words * overlap_ratio)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def packed(sentences: Column, target_tokens: int = 600, overlap_ratio: float = 0.12) -> Column:
    """Sentences as an array of chunk texts: a left fold over their word counts, one step a sentence; texts are cut out at the end.

    A full buffer is emitted and its overlap begins the next one; where overlap and sentence exceed the budget again the overlap is
    dropped, so every step makes progress. A sentence that fills a budget alone is a chunk of its own. The buffer is always a run of
    sentences, so a state is the run's begin and words and the cuts so far: a step costs no more than the overlap.
    """
    most, keep = budget(target_tokens, overlap_ratio)
    span = lambda b, e: F.struct(b.cast("int").alias("b"), e.cast("int").alias("e"))
    run = lambda begin, words: F.struct(begin.cast("int").alias("begin"), words.cast("int").alias("words"))

    def overlap(a: Column, counts: Column) -> Column:
        """The last sentence (unless it fills a budget) and those before it while their words stay within the overlap."""
        if not keep:
            return run(a["i"], F.lit(0))
        size = F.least(F.lit(keep), a["i"] - a["begin"])  # every sentence has a word
        back = F.reverse(F.slice(counts, a["i"] - size + 1, size))
        start = F.struct(a["i"].alias("begin"), F.lit(0).alias("words"), F.lit(False).alias("over"))

        def step(o: Column, n: Column) -> Column:
            take = ~o["over"] & F.when(o["begin"] == a["i"], n < most).otherwise(o["words"] + n <= keep)
            words = F.when(take, o["words"] + n).otherwise(o["words"])
            return F.struct((o["begin"] - take.cast("int")).alias("begin"), words.alias("words"), (~take | (words >= keep)).alias("over"))

        return F.aggregate(back, start, step, lambda o: run(o["begin"], o["words"]))

    def cuts(counts: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("begin"), F.lit(0).alias("words"), F.expr("cast(array() as array<struct<b:int,e:int>>)").alias("cuts"))

        def step(a: Column, n: Column) -> Column:
            i, full = a["i"], (a["i"] > a["begin"]) & (a["words"] + n > most)
            first = F.when(full, overlap(a, counts)).otherwise(run(a["begin"], a["words"]))

            def rest(r: Column) -> Column:
                fresh = full & (r["words"] + n > most)
                alone = (fresh | (r["begin"] == i)) & (n >= most)
                done = F.when(full, F.concat(a["cuts"], F.array(span(a["begin"], i)))).otherwise(a["cuts"])
                return F.struct(
                    (i + 1).alias("i"),
                    F.when(alone, i + 1).when(fresh, i).otherwise(r["begin"]).alias("begin"),
                    F.when(alone, F.lit(0)).when(fresh, n).otherwise(r["words"] + n).alias("words"),
                    F.when(alone, F.concat(done, F.array(span(i, i + 1)))).otherwise(done).alias("cuts"),
                )

            return _let(first, rest)

        return F.aggregate(counts, start, step, lambda a: F.when(a["i"] > a["begin"], F.concat(a["cuts"], F.array(span(a["begin"], a["i"])))).otherwise(a["cuts"]))

    def texts(s: Column) -> Column:
        counts = F.transform(s, lambda t: S.word_count(t).cast("int"))
        return F.transform(_let(counts, cuts), lambda c: F.array_join(F.slice(s, c["b"] + 1, c["e"] - c["b"]), " "))

    return _let(sentences, texts)


def chunk_sections(sections: DataFrame, target_tokens: int = 600, overlap_ratio: float = 0.12) -> DataFrame:
    """sections (source_title, source_type, source_path, language, section, position, text, tables): rows of the chunk table without vectors.

    Non-blank tables come first, each whole; then the packed text. Overlap never crosses a section. chunk_num counts within a section.
    """
    tables = F.filter(F.coalesce("tables", F.expr("cast(array() as array<string>)")), lambda t: S.strip(t) != "")
    parts = F.concat(tables, packed(S.sentences(F.col("text")), target_tokens, overlap_ratio))
    rows = sections.select("source_title", "source_type", "source_path", "language", "section", "position", F.posexplode(parts).alias("chunk_num", "text"))
    return rows.withColumn("chunk_id", S.chunk_id(*map(F.col, ("source_path", "source_title", "section", "position", "text"))))


def section_items(items: DataFrame) -> DataFrame:
    """items (doc, seq, text, label, level, page_no, table_md): doc, section_num, title, text, position, tables.

    section_header or title items of level <= 2 open a section; a blank one keeps the title before it. Deeper headers are text. A
    section's position is the page of the item that closes it. Sections without text and tables are left out; the first title is
    Introduzione.
    """
    order = W.Window.partitionBy("doc").orderBy("seq")
    so_far = order.rowsBetween(W.Window.unboundedPreceding, 0)
    header = F.col("label").isin("section_header", "title") & (F.coalesce("level", F.lit(1)) <= 2)
    page = F.last(F.when(F.col("page_no") > 0, F.col("page_no")), ignorenulls=True).over(so_far)
    name = S.strip(S.text_of("text"))
    marked = items.select("*", header.alias("header"), page.alias("page")).withColumn("num", F.sum(F.col("header").cast("int")).over(so_far))
    marked = marked.withColumn("title", F.coalesce(F.last(F.when(F.col("header") & (name != ""), name), ignorenulls=True).over(so_far), F.lit("Introduzione")))
    table = F.col("label") == "table"
    body = ~F.col("header") & ~table & (name != "")
    pieces = marked.groupBy("doc", "num").agg(
        F.first("title").alias("title"), F.max("page").alias("own_page"), F.min(F.when(F.col("header"), F.col("page"))).alias("header_page"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(body, F.struct("seq", name.alias("t"))))), lambda x: x["t"]), " ").alias("text"),
        F.transform(F.array_sort(F.collect_list(F.when(table & (S.strip(S.text_of("table_md")) != ""), F.struct("seq", "table_md")))), lambda x: x["table_md"]).alias("tables"),
    )
    closing = F.coalesce(F.lead("header_page").over(W.Window.partitionBy("doc").orderBy("num")), F.col("own_page"))
    return pieces.withColumn("position", S.page_position(closing)).where((F.col("text") != "") | (F.size("tables") > 0)).select("doc", F.col("num").alias("section_num"), "title", "text", "position", "tables")
