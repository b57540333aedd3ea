"""Op 10: main text of web pages, with a suffix array over the pages of a host.

A page is cut into blocks, and each block knows the elements it stands in. The token streams of a host's pages are concatenated and their
suffixes sorted by prefix doubling; of each suffix, the longest common prefix with a suffix of another page is read off its nearest
neighbours from other pages. Repeats are such prefixes of REPEAT tokens and more. Pages of equal tokens are copies and count as one page;
on hosts where repeats decide about whole blocks, so do near copies, which the operator for near-duplicates finds among their texts.

What repeats decide:
- on a page without an article or main element, every block: one that passages of SHARED distinct pages cover for the most part loses the
  covered text and keeps unique runs of REPEAT tokens and more; any other block stays whole, since quotations are content;
- inside an article, elements whose names are boilerplate only in the right place (related, search, legal, notice ...): they go where
  repeats cover them, and are content otherwise;
- inside an article, any text that stands on at least WIDE of the distinct pages compared, WIDE_PAGES at least: it is cut out, and the
  rest of its block stays. Copies and passages that fewer pages share are content there.
Structure decides alone about scripts, styles, forms, menus, footers, asides and elements named as comments, adverts and the like.

A host with many pages is cut into parts of PART pages, each with a suffix array of its own. Where such a host has blocks that repeats
decide about, suffixes cut at REPEAT tokens meet over all its parts as well, as rows of a shuffle: one row of a suffix and part, so
that it doesn't matter how many pages a host has. A repeat is then seen wherever in the host its pages lie. The share of pages for WIDE is
that of a part, which a hash of its pages deals out.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.near_dedup import near_duplicates
from quern.llm.scratch import bound_batches, save
from quern.llm.words import mix

REPEAT = 8  # tokens; a power of two
COVER = 0.6  # share of a block's tokens
SHARED = 3  # distinct pages, or all of a host with fewer
ALIKE = 80  # per cent of the shingles of two pages, from which on they count as one
WIDE, WIDE_PAGES = 0.5, 10  # share of the distinct pages, and so many at least
PART = 200  # pages of a host whose streams are compared at once
PART_BYTES = 16 << 20
BROADCAST_HOSTS = 200_000  # hosts of several parts that may be broadcast, at about 50 bytes

#: Fixed HTML vocabulary.
SKIP = frozenset("script style noscript template svg iframe object canvas audio video select option button textarea input head title".split())
ASIDE = frozenset("nav aside footer form menu dialog header".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow msqrt msub msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of class and id names. A name that consists of such words, and of PLACES, marks its element.
ALWAYS = frozenset("""
ad ads adv advert adverts advertisement advertising advertisements sponsor sponsored menu nav navbar navigation breadcrumb breadcrumbs
masthead topbar footer bottombar sidebar cookie cookies consent gdpr newsletter subscribe subscription signup login comment comments disqus
respond replies reply share sharing pagination pager popup modal overlay toolbar
""".split())
#: Words that name boilerplate as well as content: repeats decide.
REPEATED = frozenset("""
navigate header aside widget notice notices alert banner promo promotion search social related recommended recommendations legal copyright
form skip
""".split())
PLACES = frozenset("left right top bottom inner outer wrapper wrap container box block section list item items area panel bar site page global main primary secondary".split())
_NAMED = re.compile(rf"\b(?:class|id)\s*=[^>]*(?:{'|'.join(sorted(REPEATED))})", re.I)
PLAIN, ASKS, OUT = 0, 1, 2  # what structure says of a block: text, text unless it repeats, not text

_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_RAW = frozenset("script style noscript template textarea title iframe svg".split())


def _standing(tag: str, attributes: str, in_article: bool) -> int:
    """PLAIN, ASKS or OUT, by an element's own tag and attributes."""
    if tag in SKIP or tag in ASIDE and not (tag == "header" and in_article):
        return OUT
    if not attributes or tag in ("html", "body"):
        return PLAIN
    values: dict[str, str] = {}
    for name, *value in _ATTRIBUTE.findall(attributes):
        values.setdefault(name.lower(), "".join(value).strip().lower())
    if "hidden" in values or values.get("aria-hidden") == "true" or _NO_DISPLAY.search(values.get("style", "")) or values.get("role") in ROLES:
        return OUT
    found = PLAIN
    for name in f"{values.get('class', '')} {values.get('id', '')}".split():
        words = set(re.split(r"[^a-z]+", name)) - PLACES - {""}
        if words and words <= ALWAYS | REPEATED:
            found = max(found, OUT if words & ALWAYS else ASKS)
    return found


def blocks(page: str | None, to_article: bool = False) -> tuple[list[tuple[str, int, bool]], bool]:
    """(text, standing, in article) of each non-empty block in order, and whether the page has an article or main element.

    to_article: read no further than to that element, which is enough to know whether there is one.
    """
    page = page or ""
    stack: list[tuple[str, int, bool]] = []  # tag, standing, in article
    places: dict[str, list[int]] = {}  # of each tag in the stack
    walls: list[int] = []  # places of block elements and tables
    out: list[tuple[str, int, bool]] = []
    buffer: list[str] = []
    found, at = False, 0

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.append((text, *(stack[-1][1:] if stack else (PLAIN, False))))
            buffer.clear()

    def cut(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop()[0]].pop()
        while walls and walls[-1] >= depth:
            walls.pop()

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    end = len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in INLINE:
                flush()
            depth, wall = last(tag), walls[-1] if walls else -1
            if depth >= 0 and not (tag in INLINE and wall > depth):
                if tag in INLINE and stack[depth][1] != (stack[depth - 1][1] if depth else PLAIN):
                    flush()
                cut(depth)
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if tag in BLOCKS and walls and stack[walls[-1]][0] == "p":  # opens the end of a paragraph
            cut(walls[-1])
        if tag in CLOSES and (open_ := last(*CLOSES[tag])) >= 0 and not (walls and walls[-1] > open_):
            cut(open_)
        _, around, inside = stack[-1] if stack else ("", PLAIN, False)
        own = max(around, _standing(tag, m[3] or "", inside))
        if own != around:
            flush()
        if tag in ("article", "main") and own != OUT:
            inside = found = True
            if to_article:
                return out, found
        if not (m[3] or "").endswith("/") or tag in BLOCKS or tag in INLINE:
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS:
                walls.append(len(stack))
            stack.append((tag, own, inside))
    flush()
    return out, found


def _ranks(text: np.ndarray, left: np.ndarray, levels: int | None = None) -> list[np.ndarray]:
    """Ranks of suffixes by their first 1, 2, 4 ... tokens, never over the `left` tokens of each; all levels that tell any apart."""
    n, ranks = len(text), [np.unique(text, return_inverse=True)[1].astype(np.int64) + 1]
    while len(ranks) != levels and 1 << len(ranks) <= left.max() and ranks[-1].max() < n:
        span = 1 << (len(ranks) - 1)
        second = np.zeros(n, dtype=np.int64)
        ok = np.flatnonzero(left > span)
        second[ok] = ranks[-1][ok + span]
        ranks.append(np.unique(ranks[-1] * (n + 2) + second, return_inverse=True)[1].astype(np.int64) + 1)
    return ranks


def _common(text: np.ndarray, left: np.ndarray, page: np.ndarray) -> np.ndarray:
    """The longest common prefix of each suffix with one of another page: that with its nearest such neighbour in the suffix array."""
    ranks, n = _ranks(text, left), len(text)
    order = np.argsort(ranks[-1], kind="stable")  # the suffix array
    by, longest = page[order], np.zeros(n, dtype=np.int64)
    run = np.concatenate(([0], np.cumsum(by[1:] != by[:-1])))
    starts = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1])))
    for other in (starts[run] - 1, np.append(starts[1:], n)[run]):
        has = np.flatnonzero((other >= 0) & (other < n))
        i, j = order[has], order[other[has]]
        room, common = np.minimum(left[i], left[j]), np.zeros(len(has), dtype=np.int64)
        for k in range(len(ranks) - 1, -1, -1):  # by halves
            more = np.flatnonzero(common + (1 << k) <= room)
            same = more[ranks[k][i[more] + common[more]] == ranks[k][j[more] + common[more]]]
            common[same] += 1 << k
        longest[i] = np.maximum(longest[i], common)
    return longest


def repeats(streams: list[np.ndarray], length: int = REPEAT, groups: list[int] | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each page and token: how many tokens from there on the longest substring has that another page has as well (0 if fewer than
    length), and how many pages have the `length` tokens from there on (0 where the page ends before). length: a power of two. groups: a
    number for each page, where some pages count as one.

    Prefix doubling as far as `length` tokens finds the suffixes that recur in another page; only these are sorted further. They come in
    runs of neighbouring places, so their common prefixes are counted in places of such a run.
    """
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    text = np.concatenate(streams) if len(streams) else np.zeros(0, dtype=np.int64)
    n = len(text)
    longest, pages = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    whole = np.zeros(0, dtype=np.int64)
    if n:
        page = np.repeat(np.arange(len(streams)), sizes)
        left = np.cumsum(sizes)[page] - np.arange(n)  # tokens up to the page's end
        group = np.array(groups if groups is not None else range(len(streams)), dtype=np.int64)[page]
        ranks = _ranks(text, left, length.bit_length())
        whole = np.flatnonzero(left >= length)
    if len(whole) and len(ranks) < length.bit_length():  # every shorter prefix is distinct
        pages[whole] = 1
    elif len(whole):
        gram = np.unique(ranks[-1][whole], return_inverse=True)[1]
        pages[whole] = np.bincount(np.unique(gram * len(streams) + group[whole]) // len(streams))[gram]
        again = np.flatnonzero(pages[whole] > 1)
        if len(again):
            at = whole[again]
            ends = np.flatnonzero(np.append((np.diff(at) > 1) | (np.diff(page[at]) > 0), True))
            inside = ends[np.searchsorted(ends, np.arange(len(at)))] - np.arange(len(at)) + 1
            longest[at] = _common(gram[again], inside, group[at]) + length - 1
    cuts = np.cumsum(sizes)[:-1]
    return (np.split(longest, cuts), np.split(pages, cuts)) if len(streams) else ([], [])


def covered(longest: np.ndarray, start: int, end: int, length: int = REPEAT) -> np.ndarray:
    """Which tokens of the block [start, end) are in repeats that lie within it; a block shorter than a repeat, in one around it."""
    if end - start < length:
        return np.full(end - start, bool((longest[max(0, end - length) : start + 1] >= length).any()))
    at = np.arange(start, end)
    upto = np.minimum(at + longest[start:end], end)
    ok = upto - at >= length
    steps = np.zeros(end - start + 1, dtype=np.int64)
    np.add.at(steps, at[ok] - start, 1)
    np.add.at(steps, upto[ok] - start, -1)
    return np.cumsum(steps)[:-1] > 0


def unique_runs(words: list[str], gone: np.ndarray, least: int) -> str:
    """The words that stay, in runs of at least so many."""
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).astype(np.int8)))
    return " ".join(" ".join(words[a:b]) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= least)


def suffix_keys(found: list[tuple[str, int, bool]], length: int = REPEAT) -> np.ndarray:
    """A 64-bit key of the first `length` tokens from each token of a page's blocks on; none of the last length - 1."""
    words = [w for text, *_ in found for w in text.split()]
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    each, keys = pd.util.hash_array(np.array(words, dtype=object)), np.zeros(n, dtype=np.uint64)
    for k in range(length):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n])
    return keys.view(np.int64)


def content_key(found: list[tuple[str, int, bool]]) -> int:
    """A 64-bit key of a page's tokens: equal for copies."""
    return int.from_bytes(hashlib.blake2b(" ".join(w for text, *_ in found for w in text.split()).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def asks(standing: int, inside: bool, has_article: bool) -> bool:
    """Whether repeats, be they on two pages, decide about a block."""
    return standing == ASKS and inside if has_article else standing != OUT


def undecided(found: list[tuple[str, int, bool]], has_article: bool) -> bool:
    return any(asks(standing, inside, has_article) for _, standing, inside in found)


def asks_of(page: str | None) -> bool:
    """undecided() of a page. Without one of the words of REPEATED in a name, nothing inside an article asks, and the page is read only as
    far as its article, if it has one."""
    named = _NAMED.search(page or "") is not None
    found, has_article = blocks(page, to_article=not named)
    return undecided(found, has_article) if named or not has_article else False


def extract_part(pages: list[str | None], marks: list[np.ndarray | None] | None = None, alike: list[object] | None = None, n_pages: int | None = None) -> list[str]:
    """Main text of pages of one host. marks: for each page, keys of its suffixes that repeat in other parts of the host. alike: a name for
    each page that near copies share; n_pages: how many such names the host has."""
    parsed = [blocks(p) for p in pages]
    number: dict[str, int] = {}
    tokens = [[text.split() for text, *_ in found] for found, _ in parsed]
    streams = [np.array([number.setdefault(w, len(number)) for b in page for w in b], dtype=np.int64) for page in tokens]
    distinct: dict[bytes, int] = {}
    own = [distinct.setdefault(s.tobytes(), len(distinct)) for s in streams]
    named: dict[object, int] = {}
    groups = [0] * len(distinct)
    for k, name in zip(own, alike or own, strict=True):
        groups[k] = named.setdefault(("own", k) if name is None else name, len(named))
    names = {g: i for i, g in enumerate(sorted(set(groups)))}
    longest, spread = repeats([np.frombuffer(s, dtype=np.int64) for s in distinct], groups=[names[g] for g in groups])
    out = []
    for (found, has_article), page, k, mark in zip(parsed, tokens, own, marks or [None] * len(pages), strict=True):
        common = spread[k] >= least_pages(len(names) if n_pages is None else n_pages)
        repeat, at, keep = longest[k] if has_article else np.where(common, REPEAT, 0), 0, []
        wide = np.where(spread[k] >= max(WIDE_PAGES, WIDE * len(names)), REPEAT, 0)
        if mark is not None:
            keys = suffix_keys(found)
            repeat = repeat.copy()
            repeat[: len(keys)] = np.maximum(repeat[: len(keys)], REPEAT * np.isin(keys, mark))
        for (text, standing, inside), words in zip(found, page, strict=True):
            end = at + len(words)
            if standing != OUT and (inside or not has_article):
                if asks(standing, inside, has_article) and (gone := covered(repeat, at, end)).mean() >= COVER:
                    text = unique_runs(words, gone, REPEAT)
                elif has_article and (gone := covered(wide, at, end)).any():
                    text = unique_runs(words, gone, 1)
                if text:
                    keep.append(text)
            at = end
        out.append(" ".join(keep))
    return out


def _html(frame: pd.DataFrame) -> list[str | None]:
    return [h if isinstance(h, str) else None for h in frame["html"]]


def hosts_that_ask(rows: DataFrame) -> DataFrame:
    """host of the pages (host, html) with blocks that repeats decide about."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"host": sorted({h for h, page in zip(frame["host"], _html(frame), strict=True) if asks_of(page)})}, dtype=object)

    return rows.select("host", "html").mapInPandas(run, "host string").distinct()


def near_copies(rows: DataFrame) -> DataFrame:
    """For pages (page, host, html): page, alike (a number that near copies share) and n_pages, how many pages of the host aren't alike. Pages
    without a word aren't counted, and are alike with none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["page"].array, "text": [" ".join(text for text, *_ in blocks(h)[0]) for h in _html(frame)]})

    texts = save(rows.select("page", "html").mapInPandas(run, "doc_id long, text string"))
    found = near_duplicates(texts, percent=ALIKE).where("n_shingles > 0").groupBy(F.col("doc_id").alias("page")).agg(F.min("component_id").alias("alike"))
    named = save(rows.select("page", "host").distinct().join(found, "page"))
    counts = named.select("host", "alike").distinct().groupBy("host").agg(F.count("*").alias("n_pages"))
    return named.join(counts, "host").select("page", "alike", "n_pages")


def least_pages(n: int | None) -> int:
    """On how many pages a passage must stand on a host of n pages, to be cut out of a page without an article."""
    return max(2, min(SHARED, int(n))) if n is not None and n == n else SHARED


def marks_between_parts(rows: DataFrame) -> DataFrame:
    """For rows (host, part, page, html, alike, n_pages) of hosts of several parts that ask: page, marks.

    marks are the keys of a page's suffixes that stand in another part of its host too, in a page that isn't alike, for pages with an
    undecided block; where the page has no article, in SHARED pages that aren't alike.
    """

    def suffixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for host, part, page, text, alike, n in zip(frame["host"], frame["part"], frame["page"], _html(frame), frame["alike"].tolist(), frame["n_pages"].tolist(), strict=True):
                found, has_article = blocks(text)
                name = int(alike) if isinstance(alike, str) else content_key(found)
                yield pd.DataFrame({"host": host, "part": part, "page": page, "content": name, "undecided": undecided(found, has_article), "least": 2 if has_article else least_pages(n), "key": np.unique(suffix_keys(found))})

    sent = rows.select("host", "part", "page", "html", F.col("alike").cast("string"), "n_pages").mapInPandas(suffixes, "host string, part int, page long, content long, undecided boolean, least int, key long")
    sent = sent.withColumn("host", F.xxhash64("host"))
    # one row of a suffix and pages that are alike, before those of a suffix meet
    pages = sent.groupBy("host", "key", "content").agg(F.min("part").alias("one"), F.max("part").alias("other"), F.max("undecided").alias("asked"))
    met = pages.groupBy("host", "key").agg(F.min("one").alias("one"), F.max("other").alias("other"), F.count("*").alias("n"), F.max("asked").alias("asked"))
    met = met.where("one < other and n > 1 and asked").select("host", "key", "n")
    own = sent.where("undecided").select("host", "page", "key", "least").join(met, ["host", "key"]).where("n >= least")
    return save(own.groupBy("page").agg(F.collect_set("key").alias("marks")))  # a page's own suffixes


def main_text(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """For pages (page_id, url, html): page_id, url, text (empty if none), n_chars.

    A host is the url's part after // up to the next /, ? or #, lower case ('' for null urls). Null html counts as empty. Repeated
    page_ids are pages of their own, but pages of a host with equal tokens, repeated rows or copies at other urls, can't make each other
    boilerplate; nor can near copies, pages of which ALIKE per cent of the shingles agree, where repeats decide about whole blocks. Every
    row gives a row, a very long page too, which is compared in a part of its own size; other columns are dropped. An empty table gives no
    rows.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    host = F.lower(F.coalesce(F.regexp_extract("url", "//([^/?#]*)", 1), F.lit("")))
    rows = rows.withColumn("host", host).withColumn("page", F.xxhash64("page_id", "url", "html"))
    parts = F.greatest(F.count("*") / PART, F.sum(F.coalesce(F.octet_length("html"), F.lit(0))) / PART_BYTES)
    hosts = rows.groupBy("host").agg(F.ceil(parts).cast("int").alias("parts")).where("parts > 1")
    # hosts of one part, by far the most, need no row; of the others a checked number may be broadcast
    several = hosts.limit(broadcast_hosts + 1).count()
    small = several <= broadcast_hosts
    asking = save(hosts_that_ask(rows))
    n_asking = asking.limit(broadcast_hosts + 1).count()
    # equal rows share a part, so that what recurs in two parts recurs in two pages
    dealt = rows.join(F.broadcast(hosts) if small else hosts, "host", "left").withColumn("part", F.pmod("page", F.coalesce("parts", F.lit(1))).cast("int"))
    if n_asking:
        asked = dealt.join(F.broadcast(asking) if n_asking <= broadcast_hosts else asking, "host", "left_semi")
        alike = save(near_copies(asked))
        marks = marks_between_parts(asked.where("parts > 1").join(alike, "page", "left")) if several else None
        dealt = dealt.join(alike, "page", "left")
        dealt = dealt.join(marks, "page", "left") if marks is not None else dealt.withColumn("marks", F.lit(None).cast("array<long>"))
    else:
        dealt = dealt.withColumns({"alike": F.lit(None).cast("long"), "n_pages": F.lit(None).cast("long"), "marks": F.lit(None).cast("array<long>")})
    dealt = dealt.select("host", "part", "page_id", "url", "html", F.col("alike").cast("string"), "n_pages", "marks")
    if not small or n_asking:  # rows lie by another key here: this moves the parts of a host apart
        dealt = dealt.repartition("host", "part")

    def extract(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("page_id", kind="stable")
        alike = [a if isinstance(a, str) else None for a in frame["alike"]]
        texts = extract_part(_html(frame), [m if isinstance(m, np.ndarray) else None for m in frame["marks"]], alike, None if frame["n_pages"].isna().all() else int(frame["n_pages"].max()))
        return pd.DataFrame({"page_id": frame["page_id"].array, "url": frame["url"].array, "text": texts, "n_chars": [len(t) for t in texts]})

    return dealt.groupBy("host", "part").applyInPandas(extract, "page_id long, url string, text string, n_chars long")
