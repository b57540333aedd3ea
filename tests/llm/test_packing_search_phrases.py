"""Packing, ranked search and collocations against the library, SQL and brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quern.llm import collocations as phrases
from quern.llm import packing, queries, ranked

DOCS = "doc_id long, text string, lang string, row string, tokens string, block string, item string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, *["x"] * 5) for i, t, lang in rows], DOCS)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def awkward():
    long = " ".join(f"word{k % 977}x{k % 31}" for k in range(30_000))
    rows = [(1, "One two three, four five.", "en"), (2, None, "en"), (3, "", None), (4, long, "en"), (None, "one two", None), (5, " \t\n.,;", "de"), (1, "One two three, four five.", "en")]
    rows += [(6, "the the the the the the the", "en"), (7, "é日本 ΑΣ Σ ß <|endoftext|> x\x00y", "xx"), (8, "a" * 5000, "en"), (9, "one\x0btwo\x0cthree\rfour\x1cfive six seven", "en")]
    return rows + [(100 + k, "a hot copy of one two three four", "en") for k in range(400)]


def test_hilbert_curve_goes_from_neighbour_to_neighbour():
    for dimensions, bits in ((2, 5), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def check_packed(rows, texts, length):
    """rows of pack_documents with ids, texts (doc_id, text): each id in exactly one piece, sequences gapless and without padding."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    library.no_truncation()
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in texts)
    ids = {(r.sequence_id, r.offset): np.frombuffer(r.ids, "<u4").tolist() for r in rows}
    assert len(ids) == len(rows)
    for r in rows:
        assert r.length == len(ids[r.sequence_id, r.offset]) > 0 and r.ids_crc32 == zlib.crc32(r.ids)
    sequences = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        sequences[r.sequence_id].append(r)
    sizes = []
    for own in sequences.values():
        ends = list(itertools.accumulate(r.length for r in own))
        assert [r.offset for r in own] == [0, *ends[:-1]]
        sizes.append(ends[-1])
    assert sorted(sequences) == list(range(len(sequences)))
    assert all(s == length or s < length and s & (s - 1) == 0 for s in sizes) and sum(s < length for s in sizes) <= length.bit_length()
    # the stream's order gives the documents back, whole
    got, part, left = Counter(), [], 0
    for k in sorted(sequences):
        for r in sequences[k]:
            assert r.start == len(part) and (not part or r.doc_tokens == left)
            part, left = part + ids[k, r.offset], r.doc_tokens
            if len(part) == left:
                got[r.doc_id, tuple(part)] += 1
                part = []
    assert not part and got == want


@pytest.mark.parametrize("length", [2048, 64])
def test_packing_on_awkward_rows(spark, awkward, length):
    out = packing.pack_documents(table(spark, awkward).repartition(5), queries.tokenizer_path("word_bpe_49k.json"), length, with_ids=True)
    check_packed(out.collect(), [r[:2] for r in awkward], length)


def test_packing_of_nothing(spark):
    path = queries.tokenizer_path("word_bpe_49k.json")
    assert packing.pack_documents(table(spark, []), path).count() == 0
    (only,) = packing.pack_documents(table(spark, [(1, None, None)]), path).collect()
    assert (only.doc_id, only.start, only.length, only.doc_tokens, only.sequence_id, only.offset) == (1, 0, 1, 1, 0, 0)
    with pytest.raises(ValueError, match="power of two"):
        packing.pack_documents(table(spark, []), path, 100)


def test_packing_puts_like_documents_together(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = packing.pack_documents(docs, queries.tokenizer_path("word_bpe_49k.json"), with_ids=True).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 2048)
    order = [lang[r.doc_id] for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    same = sum(a == b for a, b in itertools.pairwise(order)) / (len(order) - 1)
    shares = Counter(order)
    assert same > sum((n / len(order)) ** 2 for n in shares.values()) + 0.2


def brute_search(docs, items, k=20):
    terms = lambda t: Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t)))
    texts = [(i, terms(t)) for i, t in docs]
    n_docs, words, df = sum(1 for _, c in texts if c), sum(sum(c.values()) for _, c in texts), Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        asked, scored = terms(text), []
        for i, c in texts:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // max(words, 1)
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("pairs", [ranked.PAIRS, 5])
def test_search_on_awkward_rows(spark, awkward, pairs):
    items = [(1, "one two TWO three"), (2, None), (3, ""), (4, "hot"), (4, "hot"), (None, "日本 word3x3 word3x3 five"), (5, "nowhere"), (6, "the " * 1000)]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, row string")
    got = rows_of(ranked.ranked_search(table(spark, awkward).repartition(5), asked, pairs=pairs))
    assert got == brute_search([r[:2] for r in awkward], items)
    assert ranked.ranked_search(table(spark, []), asked, pairs=pairs).count() == 0
    assert ranked.ranked_search(table(spark, awkward), asked.limit(0)).count() == 0


def test_search_with_scores_beyond_a_double(spark):
    docs = [(i, "rare words " * i) for i in range(1, 40)]
    items = [(1, "rare words " * 600_000)]
    got = ranked.ranked_search(spark.createDataFrame(docs + [(99, "other")], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got) == brute_search(docs + [(99, "other")], items)


def test_pruning_is_safe_and_prunes():
    """Random documents and items: no document of the K best is lost, and frequent terms aren't needed."""
    rng = np.random.default_rng(5)
    n_docs, n_terms, n_items, k = 3000, 200, 30, 20
    share = 1 / np.arange(1, n_terms + 1)
    doc, term = np.unique(np.stack([np.repeat(np.arange(n_docs), 15), rng.choice(n_terms, 15 * n_docs, p=share / share.sum())]), axis=1)
    impact = (10**6 * np.arange(1, n_terms + 1) ** 1.5).astype(np.int64)[term] + rng.integers(0, 1000, len(term))
    item, asked = np.unique(np.stack([np.repeat(np.arange(n_items), 8), rng.choice(n_terms, 8 * n_items, p=share / share.sum())]), axis=1)
    repeats = rng.integers(1, 3, len(item))
    most = np.zeros(n_terms, dtype=np.int64)
    np.maximum.at(most, term, impact)
    exact = np.zeros((n_docs, n_items), dtype=np.int64)
    for i, t, q in zip(item, asked, repeats, strict=True):
        exact[doc[term == t], i] += q * impact[term == t]
    model = ranked.Items(item, asked, repeats, n_items, most)
    assert model.needed.all()
    kth = np.array([np.sort(impact[term == t])[-k] if (term == t).sum() >= k else 0 for t in range(n_terms)])
    floor = np.zeros(n_items, dtype=np.int64)
    np.maximum.at(floor, model.item, model.repeats * kth[model.term])
    assert (floor <= np.sort(exact, axis=0)[-k]).all() and floor.any()
    model.prune(floor)
    assert 0.2 < model.needed.mean() < 0.9
    which, whose, score = model.best(doc, term, impact, n_docs)
    assert sorted(zip(which.tolist(), whose.tolist(), score.tolist())) == [(d, i, exact[d, i]) for d, i in np.argwhere(exact >= np.maximum(floor, 1)).tolist()]


def brute_phrases(docs, least, longest=4, reported=2000):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in counts.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    most[p[i : i + size]] = max(most[p[i : i + size]], a)
        rows = []
        for p, a in candidates.items():
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            if not (most[p] and 100 * most[p] >= 80 * a):
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rows)[:reported])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "longest", "reported"), [(2, 4, 2000), (3, 2, 5), (2, 6, 40)])
def test_phrases_on_awkward_rows(spark, awkward, least, longest, reported):
    rng = random.Random(3)
    words = ["a", "b", "c", "Dd", "é", "日", "e\x1cf", "g h"]
    rows = awkward + [(1000 + k, "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", ".", "\x0c", "\n"]) for _ in range(rng.randrange(120))), rng.choice(["en", "fr", None])) for k in range(60)]
    got = phrases.collocations(table(spark, rows).repartition(7), least, longest, reported)
    assert rows_of(got) == brute_phrases([(lang, t) for _, t, lang in rows], least, longest, reported)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(table(spark, [])).count() == 0
    assert phrases.collocations(table(spark, [(1, None, None), (2, "", "en"), (3, "one two", "en")])).count() == 0


def test_bitmaps_agree_with_counting(monkeypatch):
    monkeypatch.setattr(phrases, "EXPANDED", 50)
    monkeypatch.setattr(phrases, "ROOT_ENTRIES", 20)
    rng = np.random.default_rng(2)
    stream = rng.integers(-1, 6, 500).astype(np.int32)
    maps = phrases.Bitmaps(stream)
    want = {k: Counter(g for i in range(len(stream) - k + 1) if min(g := tuple(stream[i : i + k].tolist())) >= 0) for k in (2, 3, 4)}
    got = Counter()
    for key, n in phrases.pair_counts(maps):
        got.update({(int(x) // maps.n_words, int(x) % maps.n_words): int(c) for x, c in zip(key, n, strict=True)})
    assert got == want[2]
    often = {p for p, n in want[2].items() if n >= 9}
    found = Counter()
    for rows, n in phrases.longer_counts(maps, np.sort(np.array([a * maps.n_words + b for a, b in often]))):
        found.update({tuple(r): int(c) for r, c in zip(rows.tolist(), n, strict=True)})
    assert found == Counter({p: n for k in (3, 4) for p, n in want[k].items() if all(pair in often for pair in itertools.pairwise(p))})


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits: 2,000,000 times a, and shares of it."""
    words = spark.createDataFrame([("en", b"x", 6 * 10**18, 1), ("en", b"y", 5 * 10**18, 2)], "lang string, word binary, f long, id long")
    pairs = spark.createDataFrame([([1, 2], 4 * 10**18 + 1), ([1, 2, 1], 3 * 10**18)], "ids array<long>, f long")
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in phrases._ranked(pairs.unionByName(spark.createDataFrame([([2, 1], 10**18 * 3)], "ids array<long>, f long")), words, 10, 80).collect()}
    assert got["x y"] == (4 * 10**18 + 1, 6 * 10**18, 5 * 10**18, 2_000_000 * (4 * 10**18 + 1) // (11 * 10**18))
    assert "y x" not in got


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_collocations"])
def test_queries_agree_with_sql(spark, data, awkward, tmp_path, name):
    folders = [f"{data}/sf0.001", str(tmp_path)]
    table(spark, [r for r in awkward if r[0] != 4] + [(2000 + k, "one TWO three. Four", "en") for k in range(40)]).select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "One two two"), (1, None), (None, "hot the")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for folder in folders:
        duck = duckdb.connect()
        for t in ("documents", "benchmark"):
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder == str(tmp_path) else ''}')")
        want = duck.execute(queries.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        got = queries.queries()[name](spark, folder)
        assert sorted(got.columns) == sorted(columns)
        assert rows_of(got.select(columns)) == sorted(want.fetchall(), key=repr)
