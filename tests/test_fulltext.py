"""The index in segments: refreshed ones equal fresh ones, and searches read only the blocks that matter."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import fulltext, retrieval
from quern.operators.fulltext import FullTextIndex
from quern.plans import queries
from quern.sources import shared

WORDS = [f"w{i}" for i in range(300)]


def texts(rng, n):
    return {i: " ".join(rng.choices(WORDS, weights=[1 / (k + 1) for k in range(300)], k=rng.randrange(1, 80))) for i in range(n)}


def table(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "w0 w1"), (2, "w0 w250 w7"), (3, "w299"), (4, "nothing of it"), (5, "w1 w1 w2")], "query_id int, query string")


def same(index, fresh, asked):
    assert rows(index.counts()) == rows(fresh.counts()) and rows(index.stats()) == rows(fresh.stats()) and rows(index.postings()) == rows(fresh.postings())
    assert rows(index.search(asked, 9)) == rows(fresh.search(asked, 9))


def test_refreshed_indexes_equal_fresh_ones(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(fulltext, "MOST_SEGMENTS", 2)
    rng = random.Random(5)
    docs = texts(rng, 400)
    index = FullTextIndex.build(table(spark, docs), str(tmp_path / "i"), "doc_id")
    assert index.refresh(table(spark, docs)) == 0 and len(index._segments()) == 1
    counted = []
    for step in range(3):
        changed = rng.sample(sorted(docs), 12)
        docs |= {i: t for i, t in zip(changed[:6], texts(rng, 6).values(), strict=True)}
        docs[changed[6]], docs[changed[7]] = None, ""
        for i in changed[8:]:
            del docs[i]
        docs |= {1000 * (step + 1) + i: t for i, t in texts(rng, 5).items()}
        counted.append(index.refresh(table(spark, docs)))
        fresh = FullTextIndex.build(table(spark, docs), str(tmp_path / f"f{step}"), "doc_id")
        same(index, fresh, asked)
        assert rows(index.search(asked, 9)) == rows(retrieval.bm25(table(spark, docs), asked, 9, "doc_id"))
    assert all(11 <= n <= 13 for n in counted)  # the changed ones alone are tokenised; a text that is gone anyway isn't
    # the third segment was one too many: the small ones are one now, and the folders of the others go with the versions that had them
    assert len(index._segments()) <= 2
    index.refresh(table(spark, docs | {1: "w1"}))
    index.refresh(table(spark, docs | {1: "w2"}))
    named = {s.segment for n in index.log.numbers() for s in index.log.read(n)[0]}
    assert set(shared.names_in(spark, f"{index.folder}/segments")) == named
    index.refresh(table(spark, {}))
    assert index.search(asked, 9).count() == 0 and index.stats().first().n == 0


def test_only_changed_texts_are_tokenised(spark, tmp_path, monkeypatch):
    docs = {i: f"w{i} common" for i in range(50)}
    index = FullTextIndex.build(table(spark, docs), str(tmp_path / "i"), "doc_id")
    seen = []
    plain = FullTextIndex._documents
    monkeypatch.setattr(FullTextIndex, "_documents", lambda self, t, c: (seen.append(sorted(r.doc_id for r in t.collect())), plain(self, t, c))[1])
    index.refresh(table(spark, docs | {3: "other", 77: "new"}))
    assert seen == [[3, 77]]


def test_searches_read_few_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "BLOCK", 16)
    rng = random.Random(6)
    docs = texts(rng, 4000)
    index = FullTextIndex.build(table(spark, docs), str(tmp_path / "i"), "doc_id")
    asked = spark.createDataFrame([(1, "w0 w1"), (2, "w0 w290"), (3, "w5 w9 w30")], "query_id int, query string")
    want = rows(retrieval.bm25(table(spark, docs), asked, 10, "doc_id"))
    assert rows(index.search(asked, 10)) == want == rows(index.search(asked, 10, broadcast_terms=0))
    every, read = ({r.query_id: r.n for r in t.groupBy("query_id").agg(F.count("*").alias("n")).collect()} for t in (index.bounds(asked), index.needed(asked, 10)))
    assert read[2] < 0.1 * every[2] and sum(read.values()) < 0.6 * sum(every.values()), (every, read)


def test_two_builders_share_an_index(spark, tmp_path, monkeypatch):
    docs = {i: "one two" for i in range(5)}
    plain, other = FullTextIndex._write, []

    def write(self, *args):
        made = plain(self, *args)
        if not other:
            other.append(True)
            FullTextIndex.build(table(spark, docs), str(tmp_path / "i"), "doc_id")
        return made

    monkeypatch.setattr(FullTextIndex, "_write", write)
    index = FullTextIndex.build(table(spark, docs), str(tmp_path / "i"), "doc_id")
    assert index.log.numbers() == [1] and len(shared.names_in(spark, f"{index.folder}/segments")) == 1 and index.stats().first().n == 5


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_counted_in_their_rows(spark, tmp_path):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " .,"), (4, "b a b"), (5, "A"), (6, "c c c")], "doc_id long, text string")
    found = FullTextIndex(spark, str(tmp_path / "i"), "doc_id")._documents(odd, "text")
    assert "Exchange" not in plan(found)
    got = {r.id: (r.dl, [tuple(t) for t in r.terms]) for r in found.collect()}
    assert got == {1: (0, []), 2: (0, []), 3: (0, []), 4: (3, [("a", 1), ("b", 2)]), 5: (1, [("a", 1)]), 6: (3, [("c", 3)])}


def test_blocks_go_on_over_batches(spark):
    rng = random.Random(7)
    rows = sorted((f"t{rng.randrange(9)}", f"b{rng.randrange(4)}", i, rng.randrange(1, 9), rng.randrange(9, 99)) for i in range(500))
    want = {}
    for term, block, *entry in rows:
        want.setdefault((term, block), []).append(dict(zip(("id", "tf", "dl"), entry, strict=True)))
    table = pa.table(dict(zip(("term", "block", "id", "tf", "dl"), map(list, zip(*rows, strict=True)), strict=True)))
    for size in (1, 3, 16, 500):
        got = [r for batch in fulltext._blocks(iter(table.to_batches(size))) for r in batch.to_pylist()]
        assert {(r["term"], r["block"]): r["entries"] for r in got} == want and len(got) == len(want)
        assert all((r["n"], r["most_tf"], r["least_dl"]) == (len(e), max(x["tf"] for x in e), min(x["dl"] for x in e)) for r in got for e in [r["entries"]])
    assert list(fulltext._blocks(iter(table[:0].to_batches()))) == []


def test_scores_are_summed_where_their_block_is(spark, tmp_path, asked):
    docs = texts(random.Random(8), 200)
    index = FullTextIndex.build(table(spark, docs), str(tmp_path / "i"), "doc_id")
    assert not re.search(r"hashpartitioning\(query_id#\d+, (doc_)?id#", plan(index.search(asked, 5)))
    docs[3] = "w1 w2 changed"
    index.refresh(table(spark, docs))
    found = plan(index.search(asked, 5))  # the dead are looked up among the documents that reach the least score
    assert found.index("LeftAnti") < found.index("HashAggregate(keys=[query_id")
    assert rows(index.search(asked, 5)) == rows(retrieval.bm25(table(spark, docs), asked, 5, "doc_id")) == rows(index.search(asked, 5, broadcast_terms=0))


def test_texts_are_dealt_out_by_block_before_they_are_counted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "BLOCK", 16)
    monkeypatch.setattr(fulltext, "PART_BYTES", 4000)
    docs = texts(random.Random(9), 300) | {1000: None, 1001: ""}
    one = table(spark, docs).coalesce(1)
    index = FullTextIndex(spark, str(tmp_path / "i"), "doc_id")
    dealt = index._dealt(one, "text").withColumn("p", F.spark_partition_id())
    got = [(r.block, r.p, r.doc_id) for r in dealt.collect()]
    assert sorted(i for *_, i in got) == sorted(docs) and len({p for _, p, _ in got}) > 5  # a single row group, many tasks
    assert len({(b, p) for b, p, _ in got}) == len({b for b, *_ in got}) > 20 and got == sorted(got, key=lambda r: (r[1], r[0], r[2]))
    found = index._documents(index._dealt(one, "text"), "text").select("id", "dl", "block", "terms")
    entries = "term string, block string, n int, most_tf int, least_dl int, entries array<struct<id:bigint,tf:int,dl:int>>"
    rows = found.mapInArrow(fulltext._postings, entries)
    assert plan(rows).count("Exchange ") == 1  # of texts; words aren't exchanged
    have = sorted((r.term, r.block, x.id, x.tf, x.dl) for r in rows.collect() for x in r.entries)
    block = {i: b for b, _, i in got}
    words = {i: (t or "").split() for i, t in docs.items()}
    assert have == sorted((w, block[i], i, ws.count(w), len(ws)) for i, ws in words.items() for w in set(ws))


def test_runs_are_whole_blocks_in_order(monkeypatch):
    rng = random.Random(10)
    docs = [{"id": i, "dl": 9 + i % 5, "block": f"b{i // 7:02}", "terms": [{"term": t, "tf": rng.randrange(1, 4)} for t in sorted(rng.sample(WORDS, rng.randrange(4)))]} for i in range(60)]
    kinds = pa.schema({"id": pa.int64(), "dl": pa.int32(), "block": pa.string(), "terms": pa.list_(pa.struct({"term": pa.string(), "tf": pa.int32()}))})
    want = {}
    for d in docs:
        for t in d["terms"]:
            want.setdefault((t["term"], d["block"]), []).append({"id": d["id"], "tf": t["tf"], "dl": d["dl"]})
    for run in (1, 20, 1000):
        monkeypatch.setattr(fulltext, "RUN", run)
        for size in (1, 4, 60):
            batches = pa.Table.from_pylist(docs, kinds).to_batches(size)
            rows = [[(r["term"], r["block"]) for r in b.to_pylist()] for b in fulltext._runs(iter(batches))]
            assert all(r == sorted(r) for r in rows) and (len(rows) > 1 or run == 1000)
            got = [r for b in fulltext._postings(iter(batches)) for r in b.to_pylist()]
            if run > 4:  # else a single document is a run
                assert len(got) == len(want) and {(r["term"], r["block"]): r["entries"] for r in got} == want
    assert list(fulltext._postings(iter([]))) == [] == list(fulltext._counted(iter([])))


def test_vectors_are_joined_to_the_rows_found(spark, data):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = queries.query_pipeline(spark, f"{data}/sf0.001")
        assert not re.search(r"SortMergeJoin[^\n]*Left", plan(found)) and found.count() == 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_documents_are_not_exchanged_for_the_rows_found(spark, data):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60k")  # a search's rows are fewer, documents more
    try:
        assert "SortMergeJoin" not in plan(queries.citation_context(spark, f"{data}/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def scored(pairs, postings, asking):
    kinds = pa.schema({"term": pa.string(), "query_id": pa.int32(), "idf": pa.float64(), "avgdl": pa.float64()})
    lists = {n: pa.list_(t) for n, t in (("id", pa.string()), ("tf", pa.int32()), ("dl", pa.int32()))}
    mine = pa.Table.from_pylist(postings, pa.schema({"at": pa.string(), "term": pa.string()} | lists))
    theirs = pa.Table.from_pylist(asking, pa.schema({"query_id": pa.int32(), "at": pa.string(), "least": pa.float64()}))
    return fulltext._scored(fulltext._by_term(pa.Table.from_pylist(pairs, kinds)), mine, theirs).to_pylist()


def test_a_block_is_scored_as_a_whole(monkeypatch):
    rng = random.Random(11)
    docs = {f"d{i}": {w: rng.randrange(1, 5) for w in rng.sample(WORDS[:40], rng.randrange(1, 20))} for i in range(30)}
    idf = {w: rng.random() for w in WORDS[:40]}
    want = {q: rng.sample(WORDS[:35], rng.randrange(1, 9)) for q in range(25)}
    asking = [{"query_id": q, "at": "s/b", "least": rng.choice([None, 1.5])} for q in rng.sample(range(25), 15)]
    have = {w: [i for i in docs if w in docs[i]] for w in WORDS[:40]}
    pieces = [(w, have[w][a:b]) for w in have if have[w] for a, b in ((0, 3), (3, 99))]  # a term's documents may lie in several rows
    postings = [{"at": "s/b", "term": w, "id": ids, "tf": [docs[i][w] for i in ids], "dl": [sum(docs[i].values()) for i in ids]} for w, ids in pieces if ids]
    pairs = [{"term": w, "query_id": q, "idf": idf[w], "avgdl": 9.5} for q in want for w in want[q]]
    found = {}
    for a in asking:
        for i, words in docs.items():
            score = sum(fulltext._addition(idf[w], words[w], sum(words.values()), 9.5) for w in want[a["query_id"]] if w in words)
            if score > 0:
                found[a["query_id"], i] = score, a["least"]
    must = {x for x, (score, least) in found.items() if round(score, 4) >= (least or 0)}
    assert must < set(found)
    for added in (1, 300, 1 << 20):
        monkeypatch.setattr(fulltext, "ADDED", added)
        got = scored(pairs, rng.sample(postings, len(postings)), asking)
        assert must == {(r["query_id"], r["id"]) for r in got} and len(got) == len(must) and {r["at"] for r in got} == {"s/b"}
        assert all(abs(r["score"] - found[r["query_id"], r["id"]][0]) < 1e-9 for r in got)


def test_only_asked_blocks_are_exchanged_and_no_posting_is_copied_for_a_query(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(fulltext, "BLOCK", 16)
    docs = texts(random.Random(12), 600) | {900: "lonely w1"}
    index = FullTextIndex.build(table(spark, docs), str(tmp_path / "i"), "doc_id")
    docs[900] = "w1 w2"  # the index still has postings of a term that nobody has now
    index.refresh(table(spark, docs))
    more = asked.unionByName(spark.createDataFrame([(6, "lonely w2"), (7, "lonely"), (None, "w1")], asked.schema))
    found = index.search(more, 5)
    steps = plan(found)
    assert "Generate explode" not in steps and "FlatMapCoGroupsInArrow" in steps  # no row for each query and posting
    assert steps.index("Exchange hashpartitioning(at") < steps.index("LeftSemi, BuildRight")  # what isn't asked for goes before the exchange
    want = [r for r in rows(retrieval.bm25(table(spark, docs), more.where("query_id is not null"), 5, "doc_id"))]
    assert rows(found) == want == rows(index.search(more, 5, broadcast_terms=0))


def test_a_run_is_put_in_order_in_slices(monkeypatch):
    docs = [{"id": i, "dl": 40, "block": f"b{i // 9}", "terms": [{"term": w, "tf": 1 + i % 3} for w in sorted(WORDS[i : i + 40])]} for i in range(50)]
    kinds = pa.schema({"id": pa.int64(), "dl": pa.int32(), "block": pa.string(), "terms": pa.list_(pa.struct({"term": pa.string(), "tf": pa.int32()}))})
    batches = pa.Table.from_pylist(docs, kinds).to_batches()
    want = pa.Table.from_batches(list(fulltext._postings(iter(batches)))).to_pylist()
    monkeypatch.setattr(fulltext, "SLICE", 64)
    assert max(map(len, fulltext._runs(iter(batches)))) == 64  # 2000 postings
    assert pa.Table.from_batches(list(fulltext._postings(iter(batches)))).to_pylist() == want
