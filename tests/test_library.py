"""Operators that the SQL comparison can't reach: packing, sections, stores, catalog, streams, models."""

import hashlib
import json
import re
import time
import uuid
import zipfile
from collections import deque

import pytest
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators import chunking, evaluation, fulltext, listing, projection, retrieval, skew, vectors
from quern.plans import queries as plans
from quern.schema import CHUNK_SCHEMA
from quern.sources import files, models, settings
from quern.sources.catalog import Catalog
from quern.sources.store import ChunkStore, merge
from quern.streaming import requests


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def pack(sentences, target, ratio):
    """The packing rule over lists."""
    most = int(target / 1.3)
    keep = int(most * ratio)
    out, buf, n = [], [], lambda s: len(s.split())
    for s in sentences:
        if buf and sum(map(n, buf)) + n(s) > most:
            out.append(" ".join(buf))
            kept, acc = [], 0
            for x in reversed(buf):
                if keep == 0 or (not kept and n(x) >= most) or (kept and acc + n(x) > keep):
                    break
                kept.insert(0, x)
                acc += n(x)
                if acc >= keep:
                    break
            buf = kept if sum(map(n, kept)) + n(s) <= most else []
        if not buf and n(s) >= most:
            out.append(s)
        else:
            buf.append(s)
    return out + ([" ".join(buf)] if buf else [])


def sentence(words, tag):
    return " ".join([f"{tag}{i}" for i in range(words)])


@pytest.mark.parametrize(("target", "ratio"), [(512, 0.15), (128, 0.15), (50, 0.5), (600, 0.0), (1, 0.12)])
def test_packing_agrees_with_the_rule(spark, data, target, ratio):
    split = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-ZÀÈÉÌÒÙ0-9])").split
    rows = spark.read.parquet(f"{data}/sf0.001/documents.parquet").where("n_chars < 20000").select("doc_id", "text")
    got = {r.doc_id: r.c for r in rows.select("doc_id", chunking.packed(S.sentences(F.col("text")), target, ratio).alias("c")).collect()}
    for r in rows.collect():
        assert got[r.doc_id] == pack([s.strip() for s in split(r.text) if s.strip()], target, ratio)


def test_packing_always_ends(spark):
    def packed(*sizes, target=600, ratio=0.12):
        sentences = [sentence(n, chr(65 + i)) for i, n in enumerate(sizes)]
        return [len(c.split()) for c in one(spark, chunking.packed(F.col("s"), target, ratio), s=sentences)]

    assert packed(10, 500) == [10, 500]
    assert packed(300, 200) == [300, 200]
    assert packed(70, 70, target=50, ratio=0.5) == [70, 70]


def test_chunks_of_sections(spark):
    rows = [("T", "libro", "p", "it", "S1", "p. 1", "One. Two.", ["|a|", " ", "|b|"]), ("T", "libro", "p", "it", "S2", "", "", None)]
    frame = spark.createDataFrame(rows, "source_title string, source_type string, source_path string, language string, section string, position string, text string, tables array<string>")
    got = chunking.chunk_sections(frame).collect()
    assert [r.text for r in got] == ["|a|", "|b|", "One. Two."]
    assert got[0].chunk_id == hashlib.sha256(b"p|T|S1|p. 1||a|").hexdigest()[:24]


def test_sectioning(spark):
    items = [(1, "x", "text", None, 1, ""), (2, "A", "section_header", 1, 2, ""), (3, "y", "text", None, 2, ""), (4, "deep", "section_header", 3, 2, ""), (5, "", "table", None, 3, "|t|"), (6, "", "table", None, 3, " "), (7, " ", "title", 1, 4, ""), (8, "z", "text", None, 5, "")]
    frame = spark.createDataFrame([("d", *i) for i in items], "doc string, seq long, text string, label string, level int, page_no int, table_md string")
    got = [(r.title, r.text, r.position, r.tables) for r in chunking.section_items(frame).orderBy("section_num").collect()]
    assert got == [("Introduzione", "x", "p. 2", []), ("A", "y deep", "p. 4", ["|t|"]), ("A", "z", "p. 5", [])]


def test_scalars(spark):
    assert one(spark, S.sentences(F.col("t")), t="Prima frase. Seconda frase! Terza frase? pesa 18.02 g. äh") == ["Prima frase.", "Seconda frase!", "Terza frase? pesa 18.02 g. äh"]
    assert one(spark, S.token_estimate(F.col("t")), t="a b c d e") == 6 and one(spark, S.token_estimate(F.col("t")), t="") == 0
    assert one(spark, S.name_uuid(F.col("t")), t="default::é.pdf") == str(uuid.uuid5(uuid.NAMESPACE_URL, "default::é.pdf"))
    assert [one(spark, S.file_size(F.col("n")), n=n) for n in (1023, 1024, 1536, 1152, 3 << 20)] == ["1023 B", "1.00 KB", "1.50 KB", "1.12 KB", "3.00 MB"]
    assert one(spark, S.normal_name(F.col("t")), t="x/Docling_Layout AST (v2)") == "docling_layout_ast__v2"
    assert one(spark, S.names_match(F.col("a"), F.col("b")), a="Some Guide.pdf", b="guide") and not one(spark, S.names_match(F.col("a"), F.col("b")), a="", b="guide")
    assert [one(spark, S.dense_score(F.col("d")), d=d) for d in (0.0, 0.5, 1.0, 1.0001, 3.0)] == [1.0, 0.5, 0.0, 0.5, 0.25]
    assert one(spark, S.citation(F.col("t"), F.lit(None), F.lit(""), F.col("x")), t="Solo Titolo", x="Contenuto puro") == "[Fonte: Solo Titolo]\nContenuto puro"
    assert one(spark, S.snippet(F.col("t")), t="x" * 160) == "x" * 160 and one(spark, S.snippet(F.col("t")), t="x" * 161) == "x" * 160 + "..."
    assert one(spark, S.clean_path(F.col("t")), t="/a/../b\\.\\c.pdf") == "a/b/c.pdf"
    assert one(spark, S.title_of(F.col("t")), t="x/My_Book.v2.json") == "My Book.v2" and one(spark, S.doc_type(F.col("t")), t="a.py") == "PDF"
    for raw, want in (('```json\n{"a": 1}\n``` ok', {"a": 1}), ('```JSON {"a": {"b": 2}}```', {"a": {"b": 2}}), ('so: {"a": "}"} then', {"a": "}"}), ("no", None), ("{no}", None), ("[1]", None), ('x {"a": 1} y {"b": 2}', None), (None, None)):
        found = one(spark, S.json_object(F.col("t").cast("string")), t=raw)
        assert (json.loads(found) if found else None) == want
    with pytest.raises(Exception, match="no JSON object"):
        one(spark, S.json_object(F.col("t"), strict=True), t="{no}")
    assert one(spark, S.file_name(F.col("t")), t="A \t book") == "A_book" and one(spark, S.age_seconds(F.lit(10.9), F.col("t")), t=4.0) == 6 and one(spark, S.age_seconds(F.lit(1.0), F.col("t")), t=4.0) == 0
    assert one(spark, S.day_of(F.col("t")), t=86400) == "1970-01-02" and one(spark, S.file_progress(F.col("t"), F.lit(3)), t=1) == 33.3 and one(spark, S.file_progress(F.col("t"), F.lit(0)), t=0) == 0.0
    told = one(spark, S.chat_messages(F.col("c"), F.col("t")), c="ctx", t="q?")
    assert [m.role for m in told] == ["system", "user"] and told[0].content == S.SYSTEM_PROMPT and told[1].content == "Contesto:\n\nctx\n\nDomanda: q?"


def test_redaction(spark):
    keys = ["Api_Token", "CLIENT_SECRET", "password", "db_passwd", "x_api_key", "apikey", "Authorization", "set-cookie", "credential", "private_key", "HTTP_PROXY", "https_proxy", "all_proxy", "no_proxy", "note", "long", "null"]
    values = ["v"] * 15 + ["é" * 4097, None]
    got = one(spark, S.redact(F.map_from_arrays("k", "v")), k=keys, v=values)
    assert [got[k] for k in keys] == ["<REDACTED>"] * 10 + ["<REDACTED_PROXY>"] * 3 + ["v", "v", "é" * 4096 + "...<truncated>", None]


def test_fusion_and_reranking(spark):
    ranking = lambda ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids, 1)], "chunk_id string, rank int")
    ids = lambda df: [r.chunk_id for r in df.orderBy("rank").collect()]
    dense, text = ranking(["a", "b"]), ranking(["c", "d"])
    assert ids(retrieval.fuse(dense, text, 4, 0.0)) == ["c", "d", "a", "b"] and ids(retrieval.fuse(dense, text, 4, 1.0)) == ["a", "b", "c", "d"]
    assert ids(retrieval.fuse(dense, text, 4, 0.5)) == ["a", "c", "b", "d"]
    for bad in (lambda: retrieval.fuse(dense, text, 4, 5), lambda: retrieval.fuse(dense, text, 0), lambda: retrieval.rerank(dense, F.lit(1), -1)):
        with pytest.raises(ValueError):
            bad()
    scored = spark.createDataFrame([("a", 1, 0.1), ("b", 2, 0.9), ("c", 3, 0.5)], "chunk_id string, rank int, s double")
    got = retrieval.rerank(scored, F.col("s"), 2).orderBy("final_rank").collect()
    assert [(r.chunk_id, r.rerank_score, r.rank_delta) for r in got] == [("b", 0.9, 1), ("c", 0.5, 1)]


def test_hybrid_modes_and_hostile_queries(spark):
    rows = [("1", "linguaggio C++ e Python", [1.0, 0.0]), ("2", "operatore AND e OR", [0.0, 1.0]), ("3", "campo foo:bar", [0.5, 0.5])]
    table = spark.createDataFrame(rows, "chunk_id string, text string, vector array<float>")
    for q in ('"', "(", "AND", "*", "", "x" * 5000, "😀 foo:bar"):
        retrieval.hybrid_search(table, [1.0, 0.0], q, 3, "hybrid").collect()
    assert retrieval.hybrid_search(table, None, "foo", 2, "BM25").first().chunk_id == "3"
    assert [r.chunk_id for r in retrieval.hybrid_search(table, [1.0, 0.0], "", 2, "dense").collect()] == ["1", "3"]
    assert retrieval.hybrid_search(table, [1.0, 0.0], "", 2, None).first().bm25_score == 0.0
    with pytest.raises(ValueError):
        retrieval.hybrid_search(table, [1.0, 0.0], "x", 2, "banana")
    with pytest.raises(Exception, match="length"):
        retrieval.knn(table, [1.0], 2).collect()


def test_full_text_without_broadcast(spark, data):
    docs, asked = spark.read.parquet(f"{data}/sf0.001/documents.parquet"), spark.read.parquet(f"{data}/sf0.001/benchmark.parquet")
    asked = asked.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    small, large = (sorted(map(tuple, retrieval.bm25(docs, asked, 10, "doc_id", broadcast_terms=n).collect())) for n in (10**6, 0))
    assert small and small == large


def test_metrics(spark):
    flags = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False)], "case_id int, rank int, relevant boolean")
    assert {r.case_id: (r.precision, r.recall) for r in evaluation.context_metrics(flags).collect()} == {1: (0.8333, 1.0), 2: (0.0, 0.0)}
    for n, want in ((1, 0.0), (20, 19.0), (100, 95.0)):
        assert evaluation.p95(spark.range(n).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v")), "g", "v").first().p95 == want
    stats = evaluation.latency_stats(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0)], "phase string, seconds double"))
    assert tuple(stats.first()) == ("a", 3, 6.0, 2.0, 1.0, 3.0)
    assert tuple(evaluation.telemetry_snapshot(stats.limit(0)).first()) == ("telemetry-system", "INFO", "FastAPI", "Sistema RAG pronto e in ascolto.", 0)
    almost = spark.createDataFrame([("rerank", 0.00199996)], "phase string, seconds double")  # cut off, not rounded
    assert tuple(evaluation.telemetry_snapshot(evaluation.latency_stats(almost)).first()) == ("telemetry-rerank", "INFO", "CrossEncoder", "Fase 'rerank' completata (1 chiamate)", 1)
    two = spark.createDataFrame([("embedding", 0.1), ("rerank", 0.25), ("rerank", 0.75)], "phase string, seconds double")
    assert [r.phase for r in evaluation.latency_stats(two, "rerank").collect()] == ["rerank"] and {r.phase for r in evaluation.latency_stats(two, "never seen").collect()} == {"embedding", "rerank"}
    assert evaluation.latency_stats(two.limit(0), "x").count() == 0
    assert evaluation.latency_report(evaluation.latency_stats(two)).first().report.split("\n") == [
        "=== Report Latenza RAG ===",
        "Fase: embedding       | Conteggio: 1   | Media: 0.100s | Min: 0.100s | Max: 0.100s | Totale: 0.100s",
        "Fase: rerank          | Conteggio: 2   | Media: 0.500s | Min: 0.250s | Max: 0.750s | Totale: 1.000s",
    ]
    assert evaluation.latency_report(stats.limit(0)).first().report == "Nessuna misurazione registrata."
    zeros = spark.createDataFrame([("g", 0.0)] * 30 + [("g", 7.0)], "g string, v double")
    assert evaluation.p95(zeros, "g", "v").first().p95 == 0.0 and evaluation.p95(zeros, "g", "v", zero_is_missing=True).first().p95 == 7.0
    odd = spark.createDataFrame([(1.0,), (3.0,), (-5.0,), (None,), (float("nan"),), (float("inf"),)], "v double")
    assert evaluation.mean_duration(odd, "v").first().mean == 2.0 and evaluation.mean_duration(odd.limit(0), "v").first().mean is None
    cases = spark.createDataFrame([(1, "Found"), (2, "Error"), (3, "Skipped")], "case_id int, status string")
    assert tuple(evaluation.job_summary(cases).first()) == ("completed_with_errors", 1, "1 casi non valutabili", "1/3")
    assert tuple(evaluation.job_summary(cases.limit(0)).first()) == ("completed", 0, None, "0/0")


def test_batches_keep_every_row(spark):
    """Many partitions, and adaptive execution that joins some: every row is there and every place once."""
    rows = spark.range(1_000_000).select((F.xxhash64("id") % 100_000).alias("v"), "id")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        for n, size in (("40", "4m"), (before["spark.sql.shuffle.partitions"], before["spark.sql.adaptive.advisoryPartitionSizeInBytes"])):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
            got = listing.batch_number(rows, "v", 32)
            n, places, least, most, wrong = got.agg(F.count("*"), F.count_distinct("place"), F.min("place"), F.max("place"), F.count_if(F.expr("batch <> (place - 1) div 32"))).first()
            assert (n, places, least, most, wrong) == (1_000_000, 1_000_000, 1, 1_000_000, 0)
            steps = got.groupBy("batch").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n"))
            assert steps.where("n <> 32").count() == 0
            assert steps.selectExpr("a >= lag(b) over (order by batch) as ok").where("not ok").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_merge_leaves_one_row_of_a_key(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int")
    twice = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("c", 4, 1)], "chunk_id string, v int, written int")
    assert sorted(tuple(r) for r in merge(stored, twice, order="written").collect()) == [("a", 3), ("b", 1), ("c", 4)]
    with pytest.raises(Exception, match="no order says"):
        merge(stored, twice.drop("written")).collect()
    assert sorted(tuple(r) for r in merge(stored, twice.drop("written").where("v > 2")).collect()) == [("a", 3), ("b", 1), ("c", 4)]


def test_joins_in_parts(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    left = spark.range(500).selectExpr("if(id < 300, 0, id % 40) as k", "id as v")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("m"))
    assert sorted(map(tuple, skew.join_in_parts(left, right, "k").collect())) == sorted(map(tuple, left.join(right.drop("n"), "k").collect()))


def test_lists_and_cases_of_any_size(spark, monkeypatch):
    rows = spark.range(100).withColumnRenamed("id", "doc_id")
    few = [tuple(r) for r in listing.fetch_in_order(rows, [7, 500, 3], "doc_id").collect()]
    monkeypatch.setattr(listing, "MOST_IDS", 1)
    assert few == [tuple(r) for r in listing.fetch_in_order(rows, [7, 500, 3], "doc_id").collect()] == [(7, 0), (3, 2)]
    cases = spark.createDataFrame([("a%",), ("b",), (None,)], "expected string")
    docs = spark.createDataFrame([("x/a%b.pdf",), (None,)], "path string")
    assert {r.expected: r.found for r in listing.exists_containing(cases, docs, "expected", "path").collect()} == {"a%": True, "b": True, None: False}
    assert not any(r.found for r in listing.exists_containing(cases, docs.limit(0), "expected", "path").collect())


def test_full_text_index(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9001, None), (9002, "..."), (9003, "the the and")], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "the and"), (2, "nowhere else"), (3, "The (tion) \"AND\" *")], "query_id int, query string")
    index = fulltext.FullTextIndex.build(docs, str(tmp_path / "fts"), "doc_id")
    want = sorted(map(tuple, retrieval.bm25(docs, asked, 7, "doc_id").collect()))
    assert want and sorted(map(tuple, index.search(asked, 7).collect())) == want == sorted(map(tuple, index.search(asked, 7, broadcast_terms=0).collect()))
    assert index.stats().first().n == docs.count()
    again = fulltext.FullTextIndex.build(docs.limit(0), str(tmp_path / "fts"), "doc_id")  # it is there: nothing is done
    assert again.stats().first().n == docs.count()
    plan = index.search(asked, 7)._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [" in plan and "In(block, [" in plan
    empty = fulltext.FullTextIndex.build(docs.limit(0), str(tmp_path / "fts"), "doc_id", replace=True)
    assert empty.search(asked, 7).count() == 0
    path = str(tmp_path / "t")
    docs.limit(5).write.parquet(path)
    first = fulltext.snapshot_key(spark.read.parquet(path))
    assert first == fulltext.snapshot_key(spark.read.parquet(path))
    docs.limit(1).write.mode("append").parquet(path)
    assert first != fulltext.snapshot_key(spark.read.parquet(path))


def test_a_question_from_retrieval_to_answer(spark):
    rows = [("1", "linguaggio C++ e Python", [1.0, 0.0], "T1", "articolo", "S", "p. 3"), ("2", "operatore AND e OR", [0.0, 1.0], None, None, None, None), ("3", "x" * 161, [0.5, 0.5], "T3", "video", "", "")]
    table = spark.createDataFrame(rows, "chunk_id string, text string, vector array<float>, source_title string, source_type string, section string, position string")
    by_length = lambda q, texts: [float(len(t)) for t in texts]
    view, answer = retrieval.ask(table, "operatore python", [1.0, 0.0], lambda p: f"ok {p.count('[Fonte')}", by_length, top_n=2, model="m")
    got = view.collect()
    assert [(r.id, r.chunk_num, r.rerank_score) for r in got] == [("3", 1, 161.0), ("1", 2, 23.0)] and got[0].rank_delta == 2
    assert got[0].highlight_snippet == "x" * 160 + "..." and (got[1].doc_type, got[1].char_offset, got[1].embedding_model, got[1].dimensions) == ("Ricerca", "p. 3", "m", None)
    assert len(view.columns) == 19 and tuple(answer.first()) == ("ok 2", False)
    kept, _ = retrieval.ask(table, "operatore python", [1.0, 0.0], str, None, top_n=2)  # no reranker: the first by rank
    failed, told = retrieval.ask(table, "operatore python", [1.0, 0.0], lambda p: 1 / 0, lambda q, texts: [1.0], top_n=2)  # wrong number of scores
    assert [r.id for r in kept.collect()] == [r.id for r in failed.collect()] == ["1", "2"]
    assert [r.rerank_score for r in kept.collect()] == [r.dense_score for r in kept.collect()] and {r.rerank_score for r in failed.collect()} == {0.0}
    assert {r.rank_delta for r in failed.collect()} == {0} and failed.collect()[1].doc_title == "Sconosciuto"
    assert told.first().failed and told.first().answer.startswith("Errore durante la generazione LLM (division by zero). Ecco i passaggi principali trovati nel contesto:\n- [T1] linguaggio C++ e Python...")
    nothing, said = retrieval.ask(table, "assente", None, lambda p: 1 / 0, mode="sparse")
    assert nothing.count() == 0 and tuple(said.first()) == (models.NO_CONTEXT, False)
    with pytest.raises(ValueError, match="blank"):
        retrieval.ask(table, "  ", None, str)


def test_fusion_by_query(spark):
    side = lambda rows: spark.createDataFrame(rows, "query_id int, chunk_id string, rank int")
    dense, text = side([(1, "a", 1), (1, "b", 2), (2, "c", 1)]), side([(1, "b", 1), (2, "d", 1), (3, "e", 1)])
    got = retrieval.fuse(dense, text, 1, 0.3, by=("query_id",)).select("query_id", "chunk_id", "rank")
    assert sorted(map(tuple, got.collect())) == [(1, "b", 1), (2, "d", 1), (3, "e", 1)]


def test_evaluation_cases(spark):
    cases = spark.createDataFrame([(1, "docs/My Guide.pdf"), (2, "other.md"), (3, "gone.pdf")], "case_id int, expected string")
    present = spark.createDataFrame([(1, True), (2, True), (3, False)], "case_id int, found boolean")
    found = spark.createDataFrame([(1, 1, "x"), (1, 2, "my guide"), (2, 1, "x"), (3, 1, "gone")], "case_id int, rank int, title string")
    got = {r.case_id: tuple(r)[1:] for r in evaluation.case_results(cases, present, found).collect()}
    assert got == {1: ("Found", 0.5, 1.0, 0.75), 2: ("Not found", 0.0, 0.0, 0.0), 3: ("Skipped", None, None, 0.0)}


def test_store_catalog_and_archives(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "base"))
    db = catalog.create(" My base ", dimension=2)
    rows = lambda *r: spark.createDataFrame([(i, "t", v, "s", "libro", "", "", "p", "it") for i, v in r], CHUNK_SCHEMA)
    store = catalog.store(db["id"])
    assert store.count() == 0 and store.upsert(rows(("a", [0.1, 0.2]), ("b", [0.0, 1.0]))) == 2
    assert store.upsert(rows(("a", [0.5, 0.5]))) == 1 and store.count() == 2
    assert store.read().where("chunk_id = 'a'").first().vector == [0.5, 0.5]
    with pytest.raises(Exception, match="length"):
        store.upsert(rows(("c", [1.0])))
    assert store.count() == 2
    more = rows(*[(f"n{i:03d}", [0.0, 0.0]) for i in range(70)]).drop("vector")
    told = []

    def loaded():
        def embedder(texts):
            if len(told_once) >= 0 and len(texts) > 32:
                raise ValueError("too many")
            return [[1.0, 2.0] for _ in texts]

        told_once = []
        return embedder

    assert store.upsert_in_batches(more, loaded, "chunk_id", upto=told.append, batches=1) == 70 and told == [32, 64, 70] and store.count() == 72
    broken = rows(*[(f"o{i:03d}", [0.0, 0.0]) for i in range(40)]).drop("vector").withColumn("text", F.when(F.col("chunk_id") >= "o032", "bad").otherwise("t"))

    def fails():
        return lambda texts: [[1.0, 2.0] if t != "bad" else 1 / 0 for t in texts]

    with pytest.raises(Exception, match="division"):
        store.upsert_in_batches(broken, fails, "chunk_id", batches=1)
    assert store.count() == 104  # the batch before the failure stays
    zipped = str(tmp_path / "x.zip")
    catalog.export(db["id"], zipped)
    copy = catalog.import_(zipped, "copy")
    assert copy["dimension"] == 2 and catalog.store(copy["id"]).count() == 104
    catalog.rename(copy["id"], "other")
    catalog.activate(copy["id"])
    with pytest.raises(ValueError):
        catalog.delete(copy["id"])
    catalog.delete(db["id"])
    with pytest.raises(KeyError):
        catalog.info(db["id"])
    for names in (["../../evil.txt"], ["/etc/x"], ["readme.txt"]):
        bad = str(tmp_path / "bad.zip")
        with zipfile.ZipFile(bad, "w") as z:
            for n in names:
                z.writestr(n, "x")
        with pytest.raises(ValueError):
            catalog.import_(bad, "bad")
    (tmp_path / "no.zip").write_text("no")
    with pytest.raises(ValueError):
        catalog.import_(str(tmp_path / "no.zip"), "bad")
    for name in ("", "x" * 101, "a\x01"):
        with pytest.raises(ValueError):
            catalog.create(name)


def test_registry_migration(spark, tmp_path):
    (tmp_path / "registry.json").write_text(json.dumps({"activeDatabase": "d", "databases": [{"id": "d", "name": "D", "path": "C:\\data\\old_db", "dimension": 3}]}))
    assert Catalog(spark, str(tmp_path)).info("d")["folderName"] == "old_db"


def test_unit_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "A_b.json").write_text(json.dumps([{"titolo": "U1", "testo": "Uno."}, {"titolo": "U2", "testo": "  "}, {"testo": "Tre."}]))
    (tmp_path / "sub" / "C.json").write_text(json.dumps([{"titolo": "U3", "testo": "Due."}]))
    (tmp_path / "Calculus PDF.json").write_text("[]")
    got = files.unit_files(spark, str(tmp_path)).orderBy("source_path", "unit_num").collect()
    assert [(r.source_title, r.section, r.text) for r in got] == [("A b", "U1", "Uno."), ("A b", "", "Tre."), ("C", "U3", "Due.")]
    (tmp_path / "bad.json").write_text('{"titolo": "x"}')
    with pytest.raises(Exception, match="not a list"):
        files.unit_files(spark, str(tmp_path)).collect()
    ups = spark.createDataFrame([("../a/b.JSON", 5), ("c.exe", 1)], "name string, bytes long")
    assert sorted((r.clean_name, r.accepted) for r in files.admitted(ups).collect()) == [("a/b.JSON", True), ("c.exe", False)]
    with pytest.raises(Exception, match="ceilings"):
        files.admitted(ups.withColumn("bytes", F.lit(300 << 20))).collect()
    pages = spark.createDataFrame([("d", 1, "x" * 150), ("d", 2, "y" * 60), ("e", 4, "z" * 900)], "doc string, page int, text string")
    assert {r.doc: r.has_text for r in files.has_text_layer(pages).collect()} == {"d": True, "e": False}
    same = spark.createDataFrame([("a/x.json", 1), ("./a/x.json", 2), ("a/x.exe", 1), ("b/noext", 1)], "name string, bytes long")
    names = sorted(r.clean_name for r in files.admitted(same).where("accepted").collect())
    assert names[0] == "a/x.json" and re.fullmatch(r"a/x_[0-9a-f]{8}\.json", names[1]) and len(names) == 2
    with pytest.raises(Exception, match="ceilings"):
        files.admitted(same, max_payload_bytes=4).collect()
    (tmp_path / "bad.json").unlink()
    chunks = files.unit_chunks(spark, str(tmp_path), 20, 0.1).orderBy("file_num", "unit_num", "chunk_num").collect()
    assert [(r.file_num, r.unit_num, r.section, r.text, r.position) for r in chunks] == [(0, 0, "U1", "Uno.", ""), (0, 2, "", "Tre.", ""), (1, 0, "U3", "Due.", "")]
    (tmp_path / "b.pdf").write_bytes(b"Uno due")
    (tmp_path / "sub" / "deep.pdf").write_bytes(b"x")
    pdfs = files.pdf_files(spark, str(tmp_path))
    assert [r.path.split("/")[-1] for r in pdfs.collect()] == ["b.pdf"]
    packed = files.pdf_chunks(pdfs, lambda c: [{"text": "Titolo", "label": "title", "page_no": 1}, {"text": c.decode(), "page_no": 1}], title="Libro")
    assert [(r.source_title, r.section, r.text, r.position) for r in packed.collect()] == [("Libro", "Titolo", "Uno due", "p. 1")]
    made = files.convert(spark.createDataFrame([("f", b"a b")], "path string, content binary"), lambda c: [{"text": w} for w in c.decode().split()])
    assert [r.text for r in made.orderBy("seq").collect()] == ["a", "b"]


def test_models(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id int, text string").coalesce(1)
    got = models.embed(rows, lambda texts: [[float(len(texts))] for _ in texts], batch=2).orderBy("id").collect()
    assert [r.vector[0] for r in got] == [2, 2, 2, 2, 1]
    with pytest.raises(Exception, match="as many vectors"):
        models.embed(rows, lambda texts: []).collect()
    chunks = spark.createDataFrame([(2, "T", "", "", "b"), (1, "T", "S", "p. 1", "a")], "rank int, source_title string, section string, position string, text string")
    prompt = models.answer_prompt(chunks, "perché?")
    assert prompt.first().prompt == "Contesto:\n\n[Fonte: T, S (p. 1)]\na\n\n[Fonte: T]\nb\n\nDomanda: perché?"
    assert models.answer(prompt, lambda p: "ok").first().answer == "ok"
    assert models.answer(models.answer_prompt(chunks.limit(0), "x"), lambda p: 1 / 0).first().answer == models.NO_CONTEXT
    got = models.embed(rows, load=lambda: lambda texts: [[1.0] for _ in texts])
    assert got.count() == 5
    counted = models.count_tokens(rows, lambda: lambda t: len(t) * 10)
    assert {r.n_tokens for r in counted.collect()} == {20} and {r.n_tokens for r in models.count_tokens(rows, lambda: 1 / 0).collect()} == {1}


def test_judge(spark):
    cases = spark.createDataFrame([(1, "q", "good", ["c1", "c2"]), (2, "q", " ", ["c"]), (3, "q", "over", ["c"]), (4, "q", "prose", ["c"]), (5, "q", "fails", ["c"]), (6, "q", "a" * 20_000, ["c" * 30_000])], "case_id int, query string, answer string, contexts array<string>")

    def model(system, user):
        assert system == models.JUDGE_PROMPT and "CONTESTO:" in user
        if "good" in user:
            assert user == "DOMANDA:\nq\n\nRISPOSTA:\ngood\n\nCONTESTO:\nc1\n\nc2"
            return '```json\n{"supported_claims": 3, "total_claims": 4}\n```'
        if "over" in user:
            return 'Sure: {"supported_claims": 9, "total_claims": 2}'
        if "prose" in user:
            return "all of it"
        if "fails" in user:
            raise ValueError("no model")
        return f'{{"supported_claims": {user.count("a")}, "total_claims": 100000, "x": {user.count("c")}}}'

    got = {r.case_id: (r.supported, r.total, r.error) for r in models.judge(cases, model).collect()}
    assert got == {1: (3, 4, None), 2: (0, 0, None), 3: (2, 2, None), 4: (None, None, "Il giudice LLM non ha restituito un JSON valido"), 5: (None, None, "no model"), 6: (12_000, 100_000, None)}


def test_rate_limit_in_batch_and_stream(spark, tmp_path):
    second = 1_000_000
    assert requests.admit([t * second for t in (0, 1, 2, 3, 60, 61)], deque(), 3) == [True, True, True, False, True, True]
    rows = [(i, c, t * second) for i, (c, t) in enumerate([(c, t) for c in (1, 2) for t in (0, 1, 2, 3, 60, 61)])]
    frame = spark.createDataFrame(rows, "event_id long, client long, ts_us long")
    want = sorted(tuple(r) for r in requests.rate_limit(frame, 3).collect())
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = requests.rate_limit_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), 3, idle_seconds=None)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("limited").collect()) == want and sum(r[3] for r in want) == 10


def test_exempt_requests_and_idle_clients(spark, tmp_path):
    assert requests.admit([0, 1, 2, 3], deque(), 2, exempt=[False, True, True, False]) == [True, True, True, False]
    frame = spark.createDataFrame([(i, 1, i, i in (1, 2)) for i in range(4)], "event_id long, client long, ts_us long, exempt boolean")
    assert [r.accepted for r in requests.rate_limit(frame, 2).orderBy("event_id").collect()] == [True, True, True, False]


def test_state_of_idle_clients_ends(spark, tmp_path):
    frame = spark.createDataFrame([(i, i % 3, i) for i in range(9)], "event_id long, client long, ts_us long")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = requests.rate_limit_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), 3, seconds=1, idle_seconds=1)
    q = stream.writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        kept = []
        for _ in range(60):  # such a query goes on with batches that have no data
            time.sleep(0.5)
            kept = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
            if 3 in kept and kept[-1] == 0:
                break
        assert 3 in kept and kept[-1] == 0 and spark.table("idle").count() == 9
    finally:
        q.stop()


def test_only_changes_are_written(spark, tmp_path):
    told = []
    spark.createDataFrame([("a", 1.0)], "phase string, seconds double").write.parquet(str(tmp_path / "in"))
    stream = requests.telemetry_stream(spark.readStream.schema("phase string, seconds double").parquet(str(tmp_path / "in"))).withColumn("at", F.current_timestamp())
    q = requests.write_changes(stream, lambda rows, batch: told.append(sorted(tuple(r)[:3] for r in rows.collect())), "at").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    spark.createDataFrame([], "phase string, seconds double").write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    spark.createDataFrame([("a", 3.0)], "phase string, seconds double").write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert told == [[("a", 1, 1.0)], [("a", 2, 4.0)]]


def test_downloads_and_counts(spark, tmp_path):
    rows = spark.createDataFrame([(3, "My  book", "x")], "chunk_num int, doc_title string, text string")
    got = listing.download(rows).first()
    assert got.name == "chunk_3_My_book.json" and json.loads(got.content) == {"chunk_num": 3, "doc_title": "My  book", "text": "x"}
    jobs = spark.createDataFrame([("pending",), ("in_progress",), ("failed",)], "status string")
    assert listing.active_jobs(jobs).first().active == 2
    rows.select(F.lit("").alias("source_path"), F.col("doc_title").alias("source_title")).repartition(2).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    size = sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
    stats = listing.library_stats(stored, 2, stored).first()
    assert (stats.chunks, stats.documents, stats.databases) == (1, 1, 2) and 0 < stats.storage_bytes <= size


def test_telemetry_stream_and_jobs(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("a", 3.0)], "phase string, seconds double").write.parquet(str(tmp_path / "in"))
    q = requests.telemetry_stream(spark.readStream.schema("phase string, seconds double").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("tele").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("tele").first()) == ("a", 2, 4.0, 2.0)
    jobs = spark.createDataFrame([("a", "running"), ("b", "completed")], "id string, status string")
    assert [r.status for r in requests.recover_jobs(jobs).orderBy("id").collect()] == ["interrupted", "completed"]


def test_pages_and_projection(spark, data):
    rows = spark.range(45)
    assert [r.chunk_num for r in listing.page(rows, 2, 20, "id").collect()] == list(range(21, 41))
    for bad in ((0, 20), (1, 101)):
        with pytest.raises(ValueError):
            listing.page(rows, *bad, "id")
    got = plans.kmeans_project(spark, f"{data}/sf0.001").collect()
    assert len({r.cluster_id for r in got}) == 4 and all(14.9 <= v <= 85.1 for r in got for v in (r.x, r.y))
    with pytest.raises(ValueError):
        projection.project(rows, "id", "v", "umap")


def test_filters_reach_the_scan(spark, data):
    plan = plans.filter_eq(spark, f"{data}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_redeem_tickets(spark):
    rows = [(1, "a", 0, True), (2, "a", 60, False), (3, "a", 61, False), (4, "b", 0, True), (5, "b", 61, False), (6, "c", 5, False), (7, "d", 0, True), (8, "d", 50, True), (9, "d", 110, False), (10, None, 0, True), (11, None, 1, False)]
    events = spark.createDataFrame([(i, t, s * 1_000_000, k) for i, t, s, k in rows], "event_id long, ticket string, ts_us long, issued boolean")
    got = {r.event_id: r.accepted for r in requests.redeem_tickets(events).collect()}
    assert got == {2: True, 3: False, 5: False, 6: False, 9: True, 11: False}


def test_settings(tmp_path):
    good = {k: low for k, (low, _) in settings.RANGES.items()} | {k: v[0] for k, v in settings.CHOICES.items()}
    kept = settings.Settings(str(tmp_path / "settings.json"), good)
    assert kept.show() == good | {"apiToken": ""}
    assert kept.update(apiToken="x", topKCandidates=7)["apiToken"] == "" and kept.stored()["apiToken"] == "x"
    assert kept.update(apiToken="", chunkOverlap=99)["topKCandidates"] == 7 and kept.stored()["apiToken"] == "x"
    for name, value in [("chunkOverlap", 100), ("portNumber", 0), ("topKCandidates", True), ("topKCandidates", "5"), ("rateLimitMax", 1.0), ("maxPayloadMB", None), ("distanceMetric", "cosine"), ("indexAlgorithm", None)]:
        with pytest.raises(ValueError, match=name):
            kept.update(**{name: value})
    assert kept.stored()["chunkOverlap"] == 99
    (tmp_path / "settings.json").write_text("[1")
    assert kept.stored() == good


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_knn_of_many_queries_agrees_with_one_at_a_time(spark, monkeypatch, metric):
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(vectors, "PUSHED_SHELLS", 3)
    made = [(i, [float(i * 7 % 5), float(i % 3), 0.0 if i % 10 == 0 else float(-i % 4)]) for i in range(40)]
    table = spark.createDataFrame(made, "chunk_id long, vector array<float>")
    asked = table.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    got = sorted(tuple(r) for r in retrieval.knn_many(table, asked, 6, metric=metric).collect())
    want = [(i, *r) for i, v in made if i % 10 == 0 for r in retrieval.knn(table, v, 6, metric=metric).collect()]
    assert got == sorted(want) and len(got) == 24
    assert retrieval.knn_many(table, asked.limit(0), 6, metric=metric).count() == 0
    with pytest.raises(Exception, match="length"):
        retrieval.knn_many(table, asked.select("query_id", F.array(F.lit(1.0)).alias("vector")), 6, metric=metric).collect()


def test_white_space_is_found_as_before(spark):
    every = spark.createDataFrame([(chr(i),) for i in range(1, 0x11000) if not 0xD800 <= i < 0xE000], "c string")
    assert every.where(F.col("c").rlike(S.NO_SPACE) == F.col("c").rlike(S.SPACE)).count() == 0
    odd = spark.createDataFrame([("",), (" ",), ("　a b c\x1f",), ("a",), ("é \n",), ("\xa0x",), (None,)], "c string")
    assert [tuple(r) for r in odd.select(S.strip(F.col("c")), S.word_count(F.col("c"))).collect()] == [("", 0), ("", 0), ("a b c", 3), ("a", 1), ("é", 1), ("x", 1), (None, 0)]


def test_long_values_are_cut_by_characters_and_events_are_spread(spark, data):
    values = ["é" * 4096, "é" * 4097, "x" * 4096, "x" * 4097, ""]
    got = one(spark, S.redact(F.map_from_arrays("k", "v")), k=list("abcde"), v=values)
    assert list(got.values()) == [values[0], "é" * 4096 + "...<truncated>", values[2], "x" * 4096 + "...<truncated>", ""]
    from quern.plans.queries import QUERIES

    assert "Exchange" in QUERIES["redact"](spark, f"{data}/sf0.001")._jdf.queryExecution().executedPlan().toString()
