"""Each operator against a brute-force version, on driver tables and on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, chat, components, decontaminate, exact_dedup, html_text, licenses, lm, near_dedup, quality, queries, sharding

from quern.operators import skew

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, words string, seed string, component_id string, best string"


def rows_of(df, *by):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, x) for x in t))


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "x", "x", "x", "x") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))
    texts = [(1, "one two three four five six seven"), (2, None), (3, ""), (4, long), (5, long + " tail"), (6, " \t\n"), (7, "one two"), (8, "one two"), (None, "one two three"), (9, "One TWO three four five six seven"), (1, "one two three four five six seven"), (10, "a" * 5000), (11, "é日本 ΑΣ Σ ß <|endoftext|> x"), (12, "MIT License. The Apache-License; GNU general public license v3 mit license")]
    return table(spark, texts)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_bpe_agrees_with_the_library(spark, data, awkward, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    own = bpe.load(path)
    rng = random.Random(1)
    odd = [rng.randrange(0x20, 0x2FFFF) for _ in range(6000)]
    texts = ["".join(chr(c) for c in odd[i : i + 30] if not 0xD800 <= c < 0xE000) for i in range(0, 6000, 30)]
    texts += ["aaaa aaaaaaa a", "it's we'll I'D", "a\x1cb\x1db\x85c\xa0d\u2003e", "<|startoftext|>hi<|endoftext|>THERE <|endof", "ΟΔΥΣΣΕΥΣ İstanbul ǅ", "e\u0301 \u212b 1234 x_y--!!", "", "\u200b\ufeff", "hahaha" * 300]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode_batch([text])[0], "<u4").tolist() == want, text
        assert own.decode(np.array(want, "<u4").tobytes()).decode() == library.decode(want, skip_special_tokens=False)
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet").unionByName(awkward.select("doc_id", "text", "lang", "source", "n_chars"))
    want = []
    for r in docs.collect():
        e = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert rows_of(bpe.bpe_round_trip(docs, path)) == sorted(want, key=lambda t: tuple((x is None, x) for x in t))
    assert bpe.bpe_round_trip(empty, path).count() == 0


@pytest.mark.parametrize("cut", [7, bpe.SLICE])
def test_bpe_words_in_arrays_agree_with_the_library(monkeypatch, cut):
    """Contractions, runs of marks, cased and combining letters, numbers of all kinds; rare letters beside; parts of few characters."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "SLICE", cut)
    path = queries.tokenizer_path("word_bpe_49k.json")
    library, own, rng = Tokenizer.from_file(path), bpe.load(path), random.Random(4)
    letters = "aAbs sStTmMdDlLrReEvV''''  \t\n--.1²½éÉΣσİ\u0301’x"
    batches = [["".join(rng.choice(letters + "日" * (k == 2)) for _ in range(rng.randrange(45))) for k in range(3)] for _ in range(1500)]
    for texts in [*batches, [f"a{chr(c)}b '{chr(c)}" for c in range(0x2200)]]:
        for text, ids in zip(texts, own.encode_batch(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def brute_sets(docs):
    out = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        out.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def brute_components(sets, percent):
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i in ids:
        for s in sets[i]:
            for g in s:
                where.setdefault(g, set()).add(i)
    pairs = {p for v in where.values() for p in itertools.combinations(sorted(v), 2)}
    for a, b in pairs:
        if any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b] if x and y):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_agree_with_brute_force(spark, data, awkward, percent):
    docs = spark.read.parquet(f"{data}/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id > 20")
    both = docs.unionByName(awkward.select("doc_id", "text"))
    sets = brute_sets([(r.doc_id, r.text) for r in both.collect()])
    want = brute_components(sets, percent)
    got = near_dedup.near_duplicates(both, percent).collect()
    assert len(got) == both.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


@pytest.mark.parametrize(("block", "family", "leaders"), [(8, 16, 16), (8, 1, 2), (25, 1, 16)])
def test_near_duplicates_of_a_family_in_blocks(spark, empty, monkeypatch, block, family, leaders):
    for name, value in (("BLOCK", block), ("FAMILY", family), ("LEADERS", leaders)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    step = [f"c{i}" for i in range(100)]  # a chain, each link of which is near only its neighbours
    for i in range(60, 90):
        texts.append((i, " ".join(step)))
        step = step[3:] + [f"c{i}x{k}" for k in range(3)]
    want = brute_components(brute_sets(texts), 85)
    assert {want[i] for i in range(60, 90)} == {60}
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, texts)).collect()} == want
    if leaders == 2:
        assert near_dedup.near_duplicates(empty).count() == 0
        assert near_dedup.keep_one_of_each(table(spark, texts), 85).columns == [c.split()[0] for c in DOCS.split(", ")]


def test_hubs_of_components_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    edges = spark.range(1, 400).selectExpr("id as a", "0L as b").unionByName(spark.range(500, 560).selectExpr("id as a", "id + 1 as b"))
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert found == {i: 0 for i in range(400)} | {i: 500 for i in range(500, 561)}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_sketches_estimate_jaccard():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for share in (0.3, 0.6, 0.9):
        b = np.concatenate((a[: int(3000 * share)], rng.integers(0, 2**63, int(3000 * (1 - share)), dtype=np.uint64)))
        a1, b1 = np.unique(near_dedup.mix(a)), np.unique(near_dedup.mix(b))
        true = len(np.intersect1d(a1, b1)) / len(np.union1d(a1, b1))
        near, either = near_dedup.estimate(near_dedup.registers([a1])[0], near_dedup.registers([b1]))
        assert abs(near[0] - true) < 0.15 and either[0] == near_dedup.BUCKETS
    # a register is the float-like form of the bucket's least remainder
    value = (np.uint64(5) << np.uint64(56)) | np.uint64(0b1011 << 20)
    sketch = near_dedup.registers([np.array([value])])
    assert sketch.dtype == np.uint16 and sketch[0, 5] == (56 - 24) << near_dedup.MANTISSA | 0b011 << near_dedup.MANTISSA - 3
    assert (near_dedup.densified(sketch) == sketch[0, 5]).all()


def test_collisions_of_registers_are_taken_off():
    rng = np.random.default_rng(9)
    sizes = [int(x) for x in rng.choice([60, 256, 1500], 400)]
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in sizes]
    sketch, spread = near_dedup.registers(sets), near_dedup.octaves(np.array(sizes))
    raw, fair = [], []
    for i in range(0, 399):
        raw.append(near_dedup.estimate(sketch[i], sketch[i + 1 :])[0])
        fair.append(near_dedup.estimate(sketch[i], sketch[i + 1 :], (spread[i], spread[i + 1 :]))[0])
    raw, fair = np.concatenate(raw), np.concatenate(fair)  # of sets that have nothing in common
    assert raw.mean() > 0.001 and abs(fair.mean()) < 0.0001


def brute_licenses(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    norm = " " + " ".join(words).lower() + " "
    spans = set()
    for label, _, rule, priority, weight in licenses.rules():  # no gate
        starts = [m.start() for m in re.finditer(f"(?={rule})", norm)]
        spans |= {(s, re.compile(rule).match(norm, s).end(), priority, label, weight) for s in starts}
    kept = [a for a in spans if not any((b[0], -b[1], b[2], b[3]) < (a[0], -a[1], a[2], a[3]) and b[1] >= a[1] and b[2] <= a[2] for b in spans)]
    score = max([s[4] for s in kept] + [0.85 if places else 0.0])
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s[3] for s in kept})), score


def test_licenses_agree_with_brute_force(spark, data, awkward, empty):
    docs = spark.read.parquet(f"{data}/sf0.01/documents.parquet").select("doc_id", "text")
    more = table(spark, [(5000, "mit license"), (5001, "submit license mit licenses mit, license"), (5002, "SPDX-License-Identifier: Apache-2.0\nThis is licensed under the terms of the BSD 3-Clause License."), (5003, "see the GNU Lesser General Public License version 2.1 or the general public\x00license"), (5004, "apache licenseé ämit license placed in the public domain"), (5005, "CC BY-SA 4.0, cc0 and the unlicense; WTFPL. All rights reserved"), (5006, "mit license " * 500)])
    both = docs.unionByName(awkward.select("doc_id", "text")).unionByName(more.select("doc_id", "text"))
    want = sorted(((r.doc_id, *brute_licenses(r.text)) for r in both.collect()), key=lambda t: tuple((x is None, x) for x in t))
    assert rows_of(licenses.license_scan(both)) == want
    assert licenses.license_scan(empty).count() == 0
    assert len(licenses.NAMES.strip().splitlines()) + len(licenses.CLAUSES.strip().splitlines()) > 130 and len(licenses.rules()) > 350


def said(pattern, last):
    """A string that a rule matches: of alternatives the first or last, of repetitions the least or most (two at most)."""
    out = []
    for op, arg in pattern:
        match str(op):
            case "LITERAL":
                out.append(chr(arg))
            case "IN":
                out.append(chr(arg[0][1]) if str(arg[0][0]) == "LITERAL" else "w")
            case "BRANCH":
                out.append(said(arg[1][-1 if last else 0], last))
            case "SUBPATTERN":
                out.append(said(arg[-1], last))
            case "MAX_REPEAT":
                out.append(said(arg[2], last) * (min(arg[1], max(arg[0], 2)) if last else arg[0]))
            case "ASSERT":
                out.append("")
            case _:
                raise ValueError(op)
    return "".join(out)


def test_licenses_of_a_text_with_very_many_matches(spark):
    import time

    docs = spark.createDataFrame([(1, "mit license " * 100_000), (2, "the mit license " * 3 + "distribution copying " * 30 + "without prior written consent")], "doc_id long, text string")
    licenses.license_scan(docs.limit(0)).collect()
    began = time.perf_counter()
    got = {r.doc_id: (r.n_base, r.labels) for r in licenses.license_scan(docs).collect()}
    assert got == {1: (100_000, "mit"), 2: (3, "mit,proprietary")} and time.perf_counter() - began < 60


def test_no_rule_matches_more_than_its_bound():
    for _, _, rule, _, _ in licenses.rules():
        longest = re.sub(r"\\S\{1,60\} ", "x" * 60 + " ", rule)
        longest = re.sub(r"\(\?:(x{60} )\)\{\d,(\d+)\}", lambda m: m[1] * int(m[2]), longest)
        assert "+" not in longest and "*" not in longest and len(longest) < licenses.MATCH_CHARS and len(longest.split()) <= licenses.MATCH_WORDS


def test_every_rule_finds_what_it_says(spark):
    import re._parser as parser

    told = sorted({(said(parser.parse(rule), last).strip(), label) for label, _, rule, *_ in licenses.rules() for last in (False, True)})
    for label, keyword, rule, *_ in licenses.rules():
        assert all(keyword in said(parser.parse(rule), last) for last in (False, True)), (label, rule)
    texts = [(i, re.sub(" ", lambda _, n=itertools.count(): (" ", "-", ",\n", " (")[next(n) % 4], t)) for i, (t, _) in enumerate(told)]
    got = dict(rows_of(licenses.license_scan(table(spark, texts)).select("doc_id", "labels")))
    found = {i: brute_licenses(t)[5] for i, t in texts}
    assert got == found and all(found.values())


def test_licenses_need_no_unrelated_words(spark, monkeypatch):
    names = ["Creative Commons Attribution 4.0", "Creative Commons Attribution International License 4.0", "Creative Commons Attribution-ShareAlike 3.0", "Creative Commons Attribution NonCommercial NoDerivatives License 4.0", "Creative Commons Zero Universal", "Do What The Fuck You Want To Public License", "CC BY 4.0", "CC0 1.0", "WTFPL"]
    texts = [(i, f"{before} {name} {after}") for i, (name, before, after) in enumerate(itertools.product(names, ("", "released under the", "terms of", "access according to"), ("", "x")))]
    got = rows_of(licenses.license_scan(table(spark, texts)))
    ungated = [(label, "", *rest) for label, _, *rest in licenses.rules()]
    monkeypatch.setattr(licenses, "rules", lambda: ungated)
    assert got == [(i, *brute_licenses(t)) for i, t in texts]
    assert all({"cc-by-4.0", "cc-by-sa-3.0", "cc-by-nc-nd-4.0", "cc0-1.0", "wtfpl"} & set(r[6].split(",")) for r in got)


def lm_texts(rows):
    streams = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None] for _, t in rows]
    return streams, [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in rows]


def brute_lm(rows, mu):
    """Scores by counts of words, pairs and triples (0: the beginning), and the probability of a word after any history."""
    streams, held = lm_texts(rows)
    count = [Counter(), Counter(), Counter()]
    for s, h in zip(streams, held, strict=True):
        if not h:
            count[0].update(s)
            count[1].update(itertools.pairwise([0, *s]))
            count[2].update(zip([0, *s], s, s[1:], strict=False))
    states = [Counter(), Counter()]
    for k in (0, 1):
        for gram, n in count[k + 1].items():
            states[k][gram[:-1]] += n
    total, kinds = sum(count[0].values()), len(count[0])

    def chance(history, w):
        if not history:
            return (count[0][w] + 1) / (total + kinds + 1)
        k = len(history)
        return (count[k][(*history, w)] + mu[k - 1] * chance(history[1:], w)) / (states[k - 1][history] + mu[k - 1])

    out = []
    for (i, _), s, h in zip(rows, streams, held, strict=True):
        told = [0, *s]
        out.append((i, h, len(s), sum(count[0][w] > 0 for w in s), total, sum(math.log10(chance((), w)) for w in s), sum(math.log10(chance(tuple(told[max(0, k - 1) : k + 1]), w)) for k, w in enumerate(s))))
    return out, chance, count[0]


def test_lm_agrees_with_brute_force(spark, data, awkward, empty, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_KEYS", 20_000)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1 << 17)
    monkeypatch.setattr(lm, "LANE", 37)
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id > 20").unionByName(awkward.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda t: tuple((x is None, x) for x in t[:5])
    for mu in (lm.MU, (3.0, 0.5)):
        want, chance, kinds = brute_lm(rows, mu)
        for a, b in zip(sorted((tuple(r) for r in lm.lm_score(docs, mu=mu).collect()), key=key), sorted(want, key=key), strict=True):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-6, rel=1e-9)
    for history in ((), (0,), ("the",), (0, "the"), ("of", "the"), ("the", "nowhere")):
        assert sum(chance(history, w) for w in [*kinds, "an unknown word"]) == pytest.approx(1)
    assert lm.lm_score(empty).count() == 0
    alone = lm.lm_score(table(spark, [(i, "x") for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2])).collect()
    assert alone and all(r.score == r.base_score == 0 and r.train_tokens == 0 for r in alone)


def test_lm_sets_texts_seen_twice_apart(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.01/documents.parquet").select("doc_id", "text")
    near = near_dedup.near_duplicates(docs, 50).select("doc_id", "component_id")
    scored = lm.lm_score(docs).where("not held_out and n_tokens > 30").join(docs, "doc_id").join(near, "doc_id").selectExpr("text", "component_id", "score / n_tokens as mean").toPandas()
    alone = scored.groupby("component_id")["mean"].transform("size") == 1
    twice = (scored.groupby("text")["mean"].transform("size") == 2) & (scored.groupby("component_id")["mean"].transform("size") == 2)
    assert twice.sum() > 10 and (scored["mean"][twice] > scored["mean"][alone].quantile(0.9)).mean() > 0.8


def test_lm_messages_are_never_more_than_keys(monkeypatch):
    keys = np.unique(near_dedup.mix(np.arange(500, dtype=np.uint64)))
    for shards in (1, 7, 10**6):
        sent = lm._messages(1, 0, 64, shards, keys, np.ones(len(keys), dtype=np.int64))
        assert len(sent) <= len(keys) and sent["shard"].is_unique
        assert np.array_equal(np.concatenate([np.cumsum(lm._unpack(b, "<u8", "<u4")[0], dtype=np.uint64) for b in sent["body"]]), keys)


def test_chat_reads_back(spark, data, awkward):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    texts = ["</s>[INST] ok [/INST]", "[\\INST] \\[/INST] <\\/s> <\\\\s>", "<|endoftext|> é日本\x00 [NAME]", "", "[", "[/", "INST]", "<s", "\\", "[SYS][\\\\/SYS]"]
    for t in texts:
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS)
    roles = ["user", "assistant", "system", "tool", None, "[/INST]"]
    rng = random.Random(2)
    turns = [(c, t, rng.choice(roles), rng.choice([*texts, None])) for c in (1, 2, 3, None) for t in range(40)] + [(1, 3, "user", "again"), (1, None, "user", "first")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("content", F.lit("clash"))
    stored = spark.read.parquet(f"{data}/sf0.01/conversations.parquet")
    both = stored.where("conv_id > 5").select("conv_id", "turn", "role", "text").withColumn("content", F.lit("")).unionByName(frame)
    groups = {}
    for r in both.collect():
        groups.setdefault(r.conv_id, []).append((r.turn is not None, r.turn, r.role or "", r.text or ""))
    want = {}
    for c, rows in groups.items():
        rows = [r[2:] for r in sorted(rows, key=lambda r: (r[0], r[1] or 0, r[2].encode(), r[3].encode()))]
        learned = "".join(t for role, t in rows if role == "assistant")
        want[c] = (len(rows), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in rows).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    got = chat.format_chat(both, path).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == want and all(r.formatted_chars >= r.loss_chars for r in got)
    assert chat.format_chat(frame.limit(0), path).count() == 0
    planted = queries.op5_chat_format(spark, f"{data}/sf0.001").where("conv_id = -1").first()
    assert planted.n_turns == 2 and planted.loss_chars == 21 and planted.formatted_chars > 42


def test_quality_on_held_out_labels(spark, data, awkward, empty):
    docs, labels = (spark.read.parquet(f"{data}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.drop("n_chars").join(labels.select("doc_id"), "doc_id", "left_semi")
    scored = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    assert ((scored["predicted"] == scored["quality"]).mean()) > 0.9
    good, bad = (scored.loc[scored["quality"] == q, "score"].to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert abs(scored["score"].mean() - scored["quality"].mean()) < 0.05
    got = quality.quality_scores(awkward, labels.where("doc_id % 2 = 0")).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality.quality_scores(empty, labels.limit(0)).count() == 0
    assert {r.score for r in quality.quality_scores(awkward, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(awkward, labels.limit(0))
    assert kept.columns == awkward.columns and kept.count() == 0  # 0.5 everywhere


def brute_quality(rows, labels, dict_rows=10**6):
    """Scores by zstandard and logistic regression alone, learned from the same halves of the labels; rows: (doc_id, text, half)."""
    import zstandard

    def fold(i):
        return zlib.crc32(str(i).encode()) % 4 == 2

    text = {}
    for i, t, _ in rows:
        text[i] = min(text.get(i, t.encode()), t.encode())
    half = {i: h for i, _, h in rows}
    known = {i: min(q for j, q in labels if j == i) for i in {j for j, q in labels if q in (0, 1)} if i in text and not fold(i)}
    pieces = lambda t: [t[k : k + 2048] for k in range(0, len(t), 2048)]
    dicts = [b""]
    for q in (1, 0):
        dicts.append(quality._train(sorted(p for i in known if half[i] == 0 and known[i] == q for p in pieces(text[i]))))
    made = []
    for d in dicts:
        options = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        made.append(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **options) if d else zstandard.ZstdCompressor(**options))

    def inputs(t):
        plain, good, bad = (sum(len(c.compress(p)) for p in pieces(t)) for c in made)
        return 10 * (bad - good) / (bad + good), math.log(plain / len(t))

    seen = [(inputs(text[i]), known[i]) for i in known if half[i] == 1]
    design = lambda d, r: np.array([1, d, d * d, r, r * r, d * r])
    x, y, w = np.array([design(*v) for v, _ in seen]), np.array([q for _, q in seen]), np.zeros(6)
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(6), x.T @ (p - y) + 0.1 * w)
    return [1 / (1 + math.exp(-design(*inputs(t.encode())) @ w)) for _, t, _ in rows]


def test_quality_agrees_with_brute_force(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    both = docs.select("doc_id", "text").unionByName(docs.where("doc_id % 50 = 1").selectExpr("doc_id", "concat(text, ' again') as text"))
    more = labels.select("doc_id", "quality").unionByName(labels.where("doc_id % 9 = 0").selectExpr("doc_id", "7 as quality"))
    rows = [tuple(r) for r in both.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))).collect()]
    want = brute_quality(rows, [(r.doc_id, r.quality) for r in more.collect()])
    got = sorted((r.doc_id, r.score) for r in quality.quality_scores(both, more).collect())
    for (i, s), (j, _, _), w in zip(got, *zip(*sorted(zip(rows, want, strict=True), key=lambda x: (x[0][0], x[1])), strict=True), strict=True):
        assert i == j and s == pytest.approx(w, abs=1e-6)
    kept = {(r.doc_id, r.text) for r in quality.keep_good(both, more).collect()}
    assert kept == {(i, t) for (i, t, _), w in zip(rows, want, strict=True) if w >= 0.7}


def test_exact_duplicates_agree_with_sql(spark, data, awkward, empty):
    docs = spark.read.parquet(f"{data}/sf0.01/documents.parquet").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    documents = docs.toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    want = duckdb.sql(queries.oracle_sql()["op7_exact_duplicates"]).fetchall()
    assert rows_of(exact_dedup.exact_duplicates(docs)) == sorted(want, key=lambda t: tuple((x is None, x) for x in t))
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == ["doc_id", "text"]
    bare = {re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in docs.collect()}
    assert len({(r.doc_id, r.text) for r in kept.collect()}) == len(bare) == kept.count()
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_shards_are_minimax(spark, data, awkward, empty, monkeypatch):
    rng = random.Random(4)
    for _ in range(60):
        sizes = np.array([rng.choice([1, 2, 3, 9, 30]) for _ in range(rng.randrange(1, 14))])
        k = rng.randrange(1, 6)
        best = min(max(int(sizes[a:b].sum()) for a, b in zip((0, *c), (*c, len(sizes)), strict=True)) for c in itertools.combinations_with_replacement(range(len(sizes) + 1), k - 1))
        shards = sharding.cut(sizes, k)
        assert sharding.smallest_capacity(sizes, k) == best == max(sizes[shards == s].sum() for s in set(shards.tolist()))
        assert (np.diff(shards) >= 0).all() and shards.max() < k
    monkeypatch.setattr(sharding, "HOT_ROWS", 7)
    docs = spark.read.parquet(f"{data}/sf0.01/documents.parquet").select("doc_id", "text").unionByName(table(spark, [(10_000 + i, "same text") for i in range(200)]).select("doc_id", "text"))
    both = docs.unionByName(awkward.select("doc_id", "text")).unionByName(table(spark, [(None, "same text")] * 60 + [(20_000, "same text")] * 60).select("doc_id", "text"))
    got = sharding.shard(both).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == both.count()
    for r in got:
        if r.doc_id in text and r.doc_id > 20:
            assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    home = {}
    for r in got:
        if r.doc_id in text and r.doc_id > 20:
            assert home.setdefault(text[r.doc_id], r.shard) == r.shard
    loads = [sum(r.size for r in got if r.shard == s) for s in range(16)]
    large = max(len(t.encode()) for t in (r.text or "" for r in both.collect()))
    assert max(loads) < max(1.05 * sum(loads) / 16, large + 5000) and min(loads) > 0.85 * sum(loads) / 16
    assert sharding.shard(empty).count() == 0


def brute_contaminated(docs, items):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, text in docs:
        d = cut(text)
        for j, item in items:
            w = cut(item)
            if min(len(d), len(w)) < 8:
                continue
            for diagonal in range(-len(w), len(d)):
                agree = [0 <= k + diagonal < len(d) and d[k + diagonal] == w[k] for k in range(len(w))]
                size = min(13, len(w))
                if any(sum(agree[b : b + size]) >= 0.8 * size for b in range(len(w) - size + 1)):
                    out.add((i, j))
    return out


@pytest.mark.parametrize("seeds", [decontaminate.BROADCAST_SEEDS, 0])
def test_decontamination_agrees_with_brute_force(spark, data, awkward, empty, seeds):
    items = spark.read.parquet(f"{data}/sf0.001/benchmark.parquet").limit(12)
    first = [r for r in items.collect()][:3]
    rng = random.Random(6)
    texts = []
    for k, r in enumerate(first):
        w = r.text.split()
        texts.append((3000 + k, "before it " + " ".join(w) + " after"))
        texts.append((3100 + k, " ".join("xx" if n % 7 == 3 else x for n, x in enumerate(w))))
        texts.append((3200 + k, " ".join(w[: len(w) // 2])))
        texts.append((3300 + k, " ".join(rng.sample(w, len(w)))))
    docs = table(spark, texts).select("doc_id", "text").unionByName(awkward.select("doc_id", "text").where("length(text) < 1000")).unionByName(spark.read.parquet(f"{data}/sf0.001/documents.parquet").where("n_chars < 1500 and doc_id > 20").select("doc_id", "text"))
    got = decontaminate.contaminated(docs, items, broadcast_seeds=seeds).collect()
    want = brute_contaminated([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], [(r.item_id, r.text) for r in items.collect()])
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {(3000 + k, r.item_id) for k, r in enumerate(first)} <= want
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == ["doc_id", "text"] and not {r.doc_id for r in left.collect()} & {d for d, _ in want}
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("seeds", [decontaminate.BROADCAST_SEEDS, 0])
def test_decontamination_with_several_texts_of_an_item(spark, seeds):
    w = [f"w{i}" for i in range(30)]
    items = spark.createDataFrame([(7, " ".join(w[:12])), (7, " ".join(w[12:])), (7, " ".join(w[:12])), (8, "too short"), (None, " ".join(w)), (9, None)], "item_id long, text string")
    docs = table(spark, [(1, " ".join(["a", *w[:12]])), (2, " ".join(w[12:])), (3, " ".join(w)), (4, None), (None, " ".join(w)), (5, "too short")]).select("doc_id", "text")
    assert rows_of(decontaminate.contaminated(docs, items, broadcast_seeds=seeds)) == [(1, 7, 12, 12, 1), (2, 7, 18, 18, 1), (3, 7, 12, 12, 1), (3, 7, 18, 18, 1)]
    assert rows_of(decontaminate.drop_contaminated(docs, items)) == [(4, None), (5, "too short"), (None, " ".join(w))]


@pytest.mark.parametrize("seeds", [decontaminate.BROADCAST_SEEDS, 0])
def test_decontamination_reads_all_texts_of_an_id(spark, seeds):
    w = [f"w{i}" for i in range(20)]
    whole, seed_only = " ".join(w), " ".join(x if i < 8 else "x" for i, x in enumerate(w))  # one has a hit on the same diagonal only
    texts = [(1, seed_only), (1, whole), (2, whole), (2, seed_only), (3, whole), (3, whole), (4, seed_only), (5, whole), (5, f"{whole} y {whole}"), (6, " ".join(w[:19] + ["x"])), (6, whole)]
    items = spark.createDataFrame([(7, whole)], "item_id long, text string")
    for order in (texts, texts[::-1]):
        docs = table(spark, order).select("doc_id", "text").coalesce(1)
        got = decontaminate.contaminated(docs, items, broadcast_seeds=seeds)
        documents, benchmark = docs.toPandas(), items.toPandas()  # noqa: F841
        assert rows_of(got) == sorted(duckdb.sql(queries.oracle_sql()["op9_contaminated"]).fetchall())
        assert rows_of(got) == [(1, 7, 20, 20, 1), (2, 7, 20, 20, 1), (3, 7, 20, 20, 1), (5, 7, 20, 20, 2), (6, 7, 20, 20, 1)]


def test_seeds_hit_every_placement_of_disagreeing_words(spark):
    texts, items = [], []
    for n in range(decontaminate.SPAN, 16):
        size = min(n, decontaminate.WINDOW)
        items.append((n, " ".join(f"i{n}w{k}" for k in range(n))))
        for gone in range(size - math.ceil(decontaminate.SHARE * size) + 1):
            for places in itertools.combinations(range(size), gone):
                agree = [k not in places for k in range(size)]
                assert any(all(agree[b + k] for k, bit in enumerate(m) if bit == "1") for m in decontaminate.MASKS for b in range(size - len(m) + 1))
        for gone in itertools.combinations(range(n), 2):  # in the text, with words around and at its end
            words = ["x" if k in gone else f"i{n}w{k}" for k in range(n)]
            texts += [" ".join(["a", "b", *words, "c"]), " ".join(["a", "b", *words[: n - 1]])]
    docs, want = list(enumerate(texts)), set()
    for i, text in docs:
        d = text.split()
        for n, item in items:
            w, size = item.split(), min(n, decontaminate.WINDOW)
            agree = [k + 2 < len(d) and d[k + 2] == w[k] for k in range(n)]
            if len(d) >= decontaminate.SPAN and any(sum(agree[b : b + size]) >= decontaminate.SHARE * size for b in range(n - size + 1)):
                want.add((i, n))
    got = decontaminate.contaminated(table(spark, docs).select("doc_id", "text"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 300


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_sql(spark, data, name):
    got = queries.queries()[name](spark, f"{data}/sf0.01")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/sf0.01/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got.select(columns)) == sorted(found.fetchall())


def test_sql_of_near_duplicates_and_chat_on_awkward_rows(spark, awkward, tmp_path):
    talk = [(1, 0, "user", "a [[INST] b <\\\\s> [/NAME] </s>"), (1, None, "tool [INST]", "x"), (1, 1, None, None), (2, 0, "assistant", "[SYS] é日本"), (2, 0, "assistant", ""), (None, 3, "system", "s")]
    chats = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    chats.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("op2_near_duplicates", "op5_chat_format"):
        found = con.execute(queries.oracle_sql()[name])
        columns = [c[0] for c in found.description]
        want = sorted(found.fetchall(), key=lambda t: tuple((x is None, x) for x in t))
        assert rows_of(queries.queries()[name](spark, str(tmp_path)).select(columns)) == want


def test_main_text(spark, data):
    page = "<html><head><title>t</title></head><body><nav>Menu a b</nav><div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; tail</h1><p>One<b>two</b> three<br>four<p>five &lt;i&gt; <script>var x='</p>'</script><style>p{}</style><aside>see also</aside><form>name</form><div id=\"comments\"><p>first!</p></div><!-- no --><p>last</article><footer>foot</footer></body></html>"
    assert html_text.extract_part([page]) == ["Head & tail Onetwo three four five <i> last"]
    same = " ".join(f"b{i}" for i in range(12))
    plain = [f"<body><div>{same}</div><p>own text number {i} {i * 7} is long enough to stay</p><div>{same} end</div></body>" for i in range(4)]
    assert html_text.extract_part(plain) == [f"own text number {i} {i * 7} is long enough to stay" for i in range(4)]
    assert html_text.extract_part([None, "", "<p>cut &am", "<div class=x", "</p></b>a < b", "<p>x"]) == ["", "", "cut &am", "", "a < b", "x"]
    rows = [(1, "http://H.x/1", page, "clash"), (2, None, None, "c"), (None, "http://h.x/2", "<p>x</p>", "c"), (1, "http://h.x/1", page, "c")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = html_text.main_text(frame)
    assert rows_of(got.select("page_id", "n_chars")) == [(1, 43), (1, 43), (2, 0), (None, 1)]
    assert html_text.main_text(frame.limit(0)).count() == 0
    stored = spark.read.parquet(f"{data}/sf0.01/pages.parquet")
    import html as entities

    other = html_text.main_text(stored.limit(60).unionByName(stored.limit(60)), broadcast_hosts=0)
    assert other.count() == 120
    for r in html_text.main_text(stored).join(stored.select("page_id", "html"), "page_id").collect():
        body = r.html.split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        body = re.sub(r"</?(?:p|h1|br)>", " ", body)
        assert r.text == " ".join(entities.unescape(re.sub(r"<[^>]*>", "", body)).split()) and r.n_chars == len(r.text)


@pytest.mark.parametrize("broadcast_hosts", [html_text.BROADCAST_HOSTS, 0])
def test_main_text_finds_repeats_in_any_part_of_a_host(spark, monkeypatch, broadcast_hosts):
    rng = random.Random(5)
    shared = [" ".join(f"s{k}w{i}" for i in range(n)) for k, n in enumerate((3, 9, 14, 30))]
    made = []
    for i in range(60):
        own = [" ".join(f"p{i}x{rng.randrange(10**6)}" for _ in range(rng.choice((4, 12, 25)))) for _ in range(3)]
        told = own + rng.sample(shared, 2) * (i % 4 != 0)
        rng.shuffle(told)
        body = "".join(f"<p>{t}</p>" for t in told)
        made.append((i, f"http://{'a.x' if i % 3 else 'b.y'}/{i}", f"<body><nav>{shared[2]}</nav>{body}</body>" if i % 5 else f"<article>{body}</article>"))
    made += [(100, "http://a.x/100", None), (1, *made[1][1:]), (101, "http://c.z/1", f"<p>{shared[3]}</p>"), (102, None, f"<p>{shared[3]}</p>")]
    monkeypatch.setattr(html_text, "WIDE_PAGES", 1000)  # the share of pages is a part's
    want = []
    for host in ("a.x", "b.y", "c.z", None):
        mine = [m for m in made if (m[1].split("/")[2] if m[1] else None) == host]
        want += [(m[0], t) for m, t in zip(mine, html_text.extract_part([m[2] for m in mine]), strict=True)]
    assert any(shared[3] in t for _, t in want) and not any(shared[3] in t for k, t in want if k < 100 and k % 5)
    monkeypatch.setattr(html_text, "PART", 4)
    frame = spark.createDataFrame(made, "page_id long, url string, html string")
    assert rows_of(html_text.main_text(frame, broadcast_hosts).select("page_id", "text")) == sorted(want)


@pytest.mark.parametrize("part", [html_text.PART, 1])
def test_main_text_keeps_copies_without_an_article(spark, monkeypatch, part):
    monkeypatch.setattr(html_text, "PART", part)
    own = [" ".join(f"p{i}x{k}" for k in range(30)) for i in range(3)]
    menu = " ".join(f"m{k}" for k in range(12))
    made = [(i, f"http://h.x/{i}", f"<p>{menu}</p><p>{t}</p>", t) for i, t in enumerate(own)]
    made += [(10 + k, f"http://h.x/0?utm={k}", f"<p id=x{k}>{menu}</p><p>{own[0]}</p>", own[0]) for k in range(6)] + [made[1], made[1]]
    made += [(20 + k, f"http://one.y/{k}", f"<p>{own[2]}</p>", own[2]) for k in range(5)] + [(30 + k, None, f"<p>{own[1]}</p>", own[1]) for k in range(5)]
    frame = spark.createDataFrame([m[:3] for m in made], "page_id long, url string, html string")
    assert rows_of(html_text.main_text(frame).select("page_id", "text")) == sorted((m[0], m[3]) for m in made)


def test_main_text_reads_attributes_and_names():
    article = "<article><p>Before <a href='/hidden-gems'>the gems</a> after.</p><div class='overflow-hidden'>a</div><p data-title='a hidden story' title=\"display:none\">b</p>{}</article>"
    kept = "Before the gems after. a b"
    for gone in ("<p hidden>x</p>", "<p HIDDEN=''>x</p>", "<p aria-hidden = 'true'>x</p>", "<p style='color:red; display : none'>x</p>", "<article class='comment'>x</article>", "<div role=dialog>x</div>"):
        assert html_text.extract_part([article.format(gone)]) == [kept], gone
    for more in ("<p aria-hidden=false>x</p>", "<p style='--display:none'>x</p>", "<p>x</p>", "<label>x</label>", "<math><mi>x</mi></math>", "<article class='post'>x</article>"):
        assert html_text.extract_part([article.format(more)]) == [f"{kept} x"], more
    assert html_text.extract_part([article.format("") + "<article class='reply'>first!</article>"]) == [kept]


def test_main_text_of_near_copies(spark, monkeypatch):
    """Pages without an article that differ in a word can't make each other boilerplate, in whatever parts they are."""
    body = " ".join(f"w{k}" for k in range(60))
    made = [(i, f"http://two.x/{i}", f"<p>{body} on {day}</p>") for i, day in enumerate(("Monday", "Tuesday"))]
    menu = " ".join(f"m{k}" for k in range(14))
    made += [(10 + i, f"http://many.x/{i}", f"<div>{menu}</div><p>{' '.join(f'p{i // 2}x{k}' for k in range(80))} day{i}</p>") for i in range(12)]  # pairs of near copies
    made += [(40 + i, f"http://pair.x/{i}", f"<div>{menu}</div><p>{' '.join(f'q{i}x{k}' for k in range(50))}</p>") for i in range(2)]
    want = [(i, re.sub(r"<[^>]*>", "", h.split("</div>")[-1])) for i, _, h in made]
    frame = spark.createDataFrame(made, "page_id long, url string, html string")
    for part in (html_text.PART, 1, 3):
        monkeypatch.setattr(html_text, "PART", part)
        assert rows_of(html_text.main_text(frame).select("page_id", "text")) == want, part


def test_main_text_is_linear_in_unclosed_tags():
    import time

    for unit in ("<b>x ", "<b>x <li>y</li>", "<b><div>x</b> ", "<li><b>x ", "<td><i>x"):
        began = time.perf_counter()
        html_text.blocks(unit * 20_000)
        assert time.perf_counter() - began < 5, unit


def test_repeats_agree_with_brute_force():
    rng = random.Random(7)
    for _ in range(60):
        pages = [np.array([rng.randrange(rng.choice((1, 3, 50))) for _ in range(rng.randrange(0, 40))], dtype=np.int64) for _ in range(4)]
        if rng.random() < 0.3:
            pages[2] = np.concatenate((pages[0], pages[1]))
        longest, spread = html_text.repeats(pages, 4)
        subs = [{tuple(p[i:j]) for i in range(len(p)) for j in range(i + 1, len(p) + 1)} for p in pages]
        for k, p in enumerate(pages):
            others = set().union(*(s for m, s in enumerate(subs) if m != k))
            want = [max((j - i for j in range(i + 4, len(p) + 1) if tuple(p[i:j]) in others), default=0) for i in range(len(p))]
            assert longest[k].tolist() == want
            assert spread[k].tolist() == [sum(tuple(p[i : i + 4]) in s for s in subs) if i + 4 <= len(p) else 0 for i in range(len(p))]
            for a, b in ((0, len(p)), (1, 4), (2, 9), (3, 7)):
                if b <= len(p) and b > a:
                    inside = {t for i in range(a, b - 3) if want[i] for t in range(i, i + 4)}
                    got = html_text.covered(longest[k], a, b, 4)
                    assert set(np.flatnonzero(got) + a) == (inside if b - a >= 4 else set(range(a, b)) if any(want[i] for i in range(max(0, b - 4), a + 1)) else set())
    assert html_text.repeats([]) == ([], [])


def test_names_mark_only_what_they_name():
    said = {"search-results": "five results for ferns", "legal-theory": "on natural law", "ad-hoc": "made for it"}
    page = "<article><p>start</p>" + "".join(f"<div class='{c}'>{t}</div>" for c, t in said.items()) + "<p id='related'>kept as well</p><div class='post comments-area'>first!</div><div class='sidebar left'>menu</div><p>end</p></article>"
    assert html_text.extract_part([page]) == [f"start {' '.join(said.values())} kept as well end"]


@pytest.mark.parametrize("part", [html_text.PART, 3])
def test_repeats_decide_inside_articles(spark, monkeypatch, part):
    """On hosts like those of pages: an article on each page, with shared passages, and a notice that the suffix array alone can tell."""
    notice = " ".join(f"notice{k}" for k in range(11))
    box = " ".join(f"more{k}" for k in range(9))
    passage = " ".join(f"passage{k}" for k in range(60))
    rng = random.Random(8)
    made, want = [], []
    for i in range(40):
        own = [" ".join(f"t{i}x{rng.randrange(10**6)}" for _ in range(25)) for _ in range(2)]
        shared = f"<p>{passage}</p>" * (i % 4 == 0)
        made.append((i, f"http://h.x/{i}", f"<nav>a menu</nav><article><h1>title {i}</h1><p>{own[0]} {notice}</p>{shared}<p class='related'>{box}</p><p class='related'>{own[1]} see</p></article><footer>f</footer>"))
        want.append((i, f"title {i} {own[0]}{f' {notice}' if part == 3 else ''}{f' {passage}' if shared else ''} {own[1]} see"))
    monkeypatch.setattr(html_text, "PART", part)
    frame = spark.createDataFrame(made, "page_id long, url string, html string")
    assert rows_of(html_text.main_text(frame).select("page_id", "text")) == want
    if part > 3:
        off = lambda streams, length=8, groups=None: ([np.zeros(len(s), dtype=np.int64) for s in streams],) * 2
        monkeypatch.setattr(html_text, "repeats", off)
        assert all(t != w for t, (_, w) in zip(html_text.extract_part([m[2] for m in made]), want, strict=True))


def test_pipeline_stages_take_effect(spark, data):
    import corpus_pipeline as pipeline

    at = f"{data}/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, at)
        assert out.columns == columns, name
        out = pipeline.save(out)
        after = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "quality":
            rejected = {r.doc_id for r in quality.quality_scores(docs, spark.read.parquet(f"{at}/labels.parquet")).where("predicted = 0").collect()}
            assert before - after == rejected
        if name == "near_dedup":
            want = brute_components(brute_sets([(r.doc_id, r.text) for r in docs.collect()]), 80)
            assert after == {i for i, c in want.items() if i == c}
        if name == "exact_dedup":
            assert len(after) == len({re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in docs.collect()})
        docs = out
        counts.append(len(after))
    assert counts == sorted(counts, reverse=True) and counts[-1] > 600
    assert {r.doc_id for r in pipeline.run(spark, at).select("doc_id").collect()} == after


def test_pipeline_stages_on_awkward_rows(spark, data, awkward, empty):
    import corpus_pipeline as pipeline

    at = f"{data}/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    more = table(spark, [(50, items[0][1]), (50, items[0][1]), (51, "x " + items[1][1] + " y"), (None, None), (None, None)])
    clashing = {c: F.lit("theirs") for c in ("_key", "key", "row", "_row", "n", "_rows", "digest", "score", "_part", "_parts", "class_id", "text_sha256", "chars", "id")}
    docs, empty = awkward.unionByName(more).withColumns(clashing), empty.withColumns(clashing)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda t: tuple((x is None, x) for x in t)
    out = {}
    for name, stage in pipeline.STAGES:
        out[name] = stage(spark, docs, at)
        assert name == "bpe" or out[name].columns == docs.columns
        assert name == "bpe" or out[name].where(" or ".join(f"{c} <> 'theirs'" for c in clashing)).count() == 0
        none = stage(spark, empty, at)
        assert none.count() == 0 and none.columns == out[name].columns
    got = {name: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=key) for name, df in out.items() if name != "bpe"}
    score = {(r.doc_id, r.text): r.score for r in docs.select("doc_id", "text").withColumn("score", quality.fitted(docs, spark.read.parquet(f"{at}/labels.parquet"))(F.col("text").cast("binary"))).collect()}
    assert got["quality"] == sorted((r for r in rows if score[r] >= 0.7), key=key)
    bare, best = (lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")), {}
    for i, t in rows:
        best[bare(t)] = min(best.get(bare(t), (1, True, 0, None)), (-len(t or ""), i is None, i or 0, t), key=lambda b: b[:3])
    assert [(i, bare(t)) for i, t in got["exact_dedup"]] == sorted((((None if none else i), k) for k, (_, none, i, _) in best.items()), key=key)
    least = brute_components(brute_sets(rows), 80)
    assert got["near_dedup"] == sorted((r for r in rows if r[0] is None or least[r[0]] == r[0]), key=key)
    bad = {i for i, _ in brute_contaminated([r for r in rows if r[0] is not None and len(r[1] or "") < 10_000], items)}
    assert bad >= {50, 51} and got["decontamination"] == sorted((r for r in rows if r[0] not in bad), key=key)
    assert sorted((r.doc_id, len(r.ids) // 4) for r in out["bpe"].collect() if r.doc_id is not None) == sorted((r.doc_id, r.n_tokens) for r in out["bpe"].collect() if r.doc_id is not None)
    assert out["bpe"].count() == len(rows)
