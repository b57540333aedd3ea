"""The library's queries bound to the driver's tables, with equivalent SQL where SQL can express them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from quern.functions import scalars as S
from quern.operators import chunking, evaluation, fulltext, listing, projection, retrieval
from quern.sources import files, shared
from quern.sources.buckets import BucketedTable
from quern.streaming import job_log as log
from quern.streaming import jobs, requests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WORDS = "the and"
TERM = "tion"
COMPONENTS = {"click": "Ollama", "view": "CrossEncoder"}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The vector of a query: one row."""
    row = vectors(spark, sf_dir).where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else []


# scans, filters, pages


@query("SELECT doc_id, lang, source, n_chars, text FROM documents")
def chunk_scan(spark, d):
    return docs(spark, d).select("doc_id", "lang", "source", "n_chars", "text")


@query("SELECT count(*) AS n FROM documents")
def chunk_count(spark, d):
    return docs(spark, d).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src1'")
def filter_eq(spark, d):
    return listing.filter_equal(docs(spark, d).select("doc_id", "lang", "source"), lang="en", source="src1")


@query("SELECT d.doc_id, lang, i.rank FROM documents d JOIN (VALUES (5, 0), (3, 1), (999999, 2), (11, 3)) i(doc_id, rank) ON d.doc_id = i.doc_id ORDER BY rank")
def filter_in(spark, d):
    return listing.fetch_in_order(docs(spark, d).select("doc_id", "lang"), [5, 3, 999999, 11], "doc_id").select("doc_id", "lang", "rank")


@query("SELECT vec_id, CAST(i - 1 AS INT) AS pos, CASE WHEN i <= 100 THEN round(CAST(embedding[i] AS DOUBLE), 5) END AS preview, CAST(embedding[i] AS DOUBLE) AS component FROM embeddings, unnest(range(1, len(embedding) + 1)) u(i) WHERE vec_id = 7")
def point_lookup(spark, d):
    """One vector: all its components, and the first 100 rounded as a preview."""
    parts = vectors(spark, d).where("vec_id = 7").limit(1).select("vec_id", F.posexplode("embedding").alias("pos", "c"))
    return parts.select("vec_id", "pos", F.when(F.col("pos") < 100, F.round(F.col("c").cast("double"), 5)).alias("preview"), F.col("c").cast("double").alias("component"))


@query("SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS chunk_num FROM documents WHERE lang = 'en' QUALIFY chunk_num BETWEEN 21 AND 40")
def page(spark, d):
    folder = f"{shared.shared_dir(spark)}/paged-{uuid.uuid4().hex}"
    shared.delete_at_end(spark, folder)
    rows = listing.PagedRows.write(docs(spark, d).where("lang = 'en'").select("doc_id", "source"), folder, "doc_id")
    return rows.page(2, 20).withColumn("chunk_num", F.col("chunk_num").cast("long"))


@query("SELECT count(*) AS total FROM documents WHERE lang = 'en'")
def page_total(spark, d):
    return docs(spark, d).where("lang = 'en'").agg(F.count("*").alias("total"))


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 500")
def sample(spark, d):
    return listing.sample(vectors(spark, d).select("vec_id", "label"), 500, "vec_id")


@query(f"SELECT doc_id, source FROM documents WHERE contains(lower(text), '{TERM}') OR contains(lower(source), '{TERM}')")
def search_substring(spark, d):
    return listing.search(docs(spark, d).select("doc_id", "source", "text"), f" {TERM.upper()} ", "text", "source").select("doc_id", "source")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' AND contains(lower(props), '\"k\": 8')")
def level_filter(spark, d):
    return listing.search(listing.filter_choice(table(spark, d, "events"), "event_type", "click"), '"K": 8', "props").select("event_id", "event_type")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT), r_name FROM region")
def bag_union(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")).unionByName(table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name")))


# scalar functions

_SENTENCES = r"list_filter([trim(s, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) for s in string_split(regexp_replace(text, '([.!?])\s+([A-ZÀÈÉÌÒÙ0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))], lambda s: s <> '')"
_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"


@query(f"SELECT doc_id, CAST(i - 1 AS INT) AS pos, s[i] AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents), unnest(range(1, len(s) + 1)) u(i)")
def sentences(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(S.sentences(F.col("text"))).alias("pos", "sentence"))


@query(f"SELECT doc_id, CAST({_WORDS} AS BIGINT) AS words, CAST(trunc({_WORDS} * 1.3::DOUBLE) AS BIGINT) AS tokens FROM documents")
def word_count(spark, d):
    return docs(spark, d).select("doc_id", S.word_count(F.col("text")).cast("long").alias("words"), S.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("SELECT doc_id, substr(sha256(source || '.pdf|' || source || '|' || lang || '||' || text), 1, 24) AS chunk_id FROM documents")
def chunk_id(spark, d):
    return docs(spark, d).select("doc_id", S.chunk_id(F.concat("source", F.lit(".pdf")), F.col("source"), F.col("lang"), F.lit(None).cast("string"), F.col("text")).alias("chunk_id"))


@query("SELECT doc_id, CASE WHEN length(text) > 160 THEN substr(text, 1, 160) || '...' ELSE text END AS snippet FROM documents")
def snippet(spark, d):
    return docs(spark, d).select("doc_id", S.snippet(F.col("text")).alias("snippet"))


@query(r"""
WITH b AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS b FROM pages),
s AS (SELECT page_id, CASE WHEN regexp_matches(b, '^.+\.[^.]+$') THEN regexp_replace(b, '\.[^.]*$', '') ELSE b END AS s FROM b)
SELECT page_id, regexp_replace(regexp_replace(lower(s), '[^\p{L}\p{N}]', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM s
""")
def name_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", S.normal_name(F.col("url")).alias("name"))


@query("SELECT doc_id, CASE WHEN n * n >= 1073741824 THEN printf('%.2f GB', n * n / 1073741824) WHEN n * n >= 1048576 THEN printf('%.2f MB', n * n / 1048576) WHEN n * n >= 1024 THEN printf('%.2f KB', n * n / 1024) ELSE printf('%d B', CAST(n * n AS BIGINT)) END AS size FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n FROM documents)")
def file_size_fmt(spark, d):
    return docs(spark, d).select("doc_id", S.file_size(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query("SELECT page_id, regexp_replace(url, '[^/]*//', '') AS raw, array_to_string(list_filter(string_split(url || '/../x//./y', '/'), lambda p: p NOT IN ('', '.', '..')), '/') AS clean FROM pages")
def path_clean(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[^/]*//", "").alias("raw"), S.clean_path(F.concat("url", F.lit("/../x//./y"))).alias("clean"))


@query("SELECT conv_id, turn, 'Contesto:' || chr(10) || chr(10) || coalesce(lag(text) OVER w, '') || chr(10) || chr(10) || 'Domanda: ' || text AS prompt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY role = 'user'")
def chat_messages(spark, d):
    w = W.Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").withColumn("before", F.lag("text").over(w)).where("role = 'user'")
    return turns.select("conv_id", "turn", S.question_prompt(F.col("before"), F.col("text")).alias("prompt"))


@query(f"""
SELECT CAST(doc_id AS VARCHAR) AS chunk_id, doc_id + 1 AS chunk_num, CASE lang WHEN 'fr' THEN 'Ricerca' WHEN 'de' THEN 'Manuale' ELSE 'Libro' END AS doc_type,
  CASE WHEN doc_id % 7 = 0 THEN 'Sconosciuto' ELSE source END AS doc_title, 'Sezione Generale' AS section,
  CASE WHEN length(text) > 160 THEN substr(text, 1, 160) || '...' ELSE text END AS snippet, CAST(trunc({_WORDS} * 1.3::DOUBLE) AS INT) AS token_count, 0.0::DOUBLE AS score
FROM documents
""")
def chunk_view(spark, d):
    kind = F.when(F.col("lang") == "fr", "articolo").when(F.col("lang") == "de", "video").when(F.col("lang") == "es", None).otherwise("libro")
    title = F.when(F.col("doc_id") % 7 != 0, F.col("source"))
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("chunk_id"), "text", title.alias("source_title"), kind.alias("source_type"), F.lit("").alias("section"), F.col("doc_id").alias("num"), F.lit(None).cast("double").alias("score"))
    return retrieval.chunk_view(rows)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), "props", F.lit(" so far.")))
    return table(spark, d, "events").select("event_id", F.get_json_object(S.json_object(fenced), "$.k").cast("long").alias("k"))


#: A key of each kind of secret, proxies, and keys that aren't secret; the SQL says what each shows.
_LOGGED = ["Api_Token", "client_SECRET", "password", "db_passwd", "X_API_KEY", "apikey2", "Authorization", "set-cookie", "credential", "ssh_private_key_path", "HTTP_PROXY", "https_proxy", "All_Proxy", "no_proxy", "my_http_proxy", "note"]


@query(f"""
SELECT event_id, key, CASE WHEN lower(key) IN ('http_proxy', 'https_proxy', 'all_proxy') THEN '<REDACTED_PROXY>'
  WHEN regexp_matches(lower(key), 'token|secret|password|passwd|api_key|apikey|authorization|cookie|credential|private_key') THEN '<REDACTED>'
  WHEN length(v) > 4096 THEN substr(v, 1, 4096) || '...<truncated>' ELSE v END AS shown
FROM (SELECT event_id, unnest({_LOGGED}) AS key, repeat(props, CAST(event_id % 3 AS INT) * 300) AS v FROM events)
""")
def redact(spark, d):
    value = F.expr("repeat(props, cast(event_id % 3 as int) * 300)")
    fields = F.map_from_arrays(F.lit(_LOGGED), F.array_repeat(value, len(_LOGGED)))
    rows = table(spark, d, "events").select("event_id", "props").repartition("event_id")  # small rows of few row groups become large ones
    return rows.select("event_id", F.explode(S.redact(fields)).alias("key", "shown"))


# chunking and documents


_PACK = f"""
WITH RECURSIVE docs AS (SELECT doc_id, source, {_SENTENCES} AS s FROM documents),
counted AS (SELECT doc_id, [len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) for t in s] AS n FROM docs),
summed AS (SELECT doc_id, n, list_prepend(0, [CAST(list_sum(n[1:k]) AS BIGINT) for k in range(1, len(n) + 1)]) AS p FROM counted),
-- one row a document and sentence: sentences begin..i - 1 are in the buffer; cuts made before sentence i and by it
walk AS (
  SELECT doc_id, n, p, 0::BIGINT AS i, 0::BIGINT AS begin, NULL::BIGINT AS b1, NULL::BIGINT AS e1, NULL::BIGINT AS b2 FROM summed
  UNION ALL
  SELECT doc_id, n, p, i + 1, CASE WHEN alone THEN i + 1 ELSE rest END, CASE WHEN closes THEN begin END, CASE WHEN closes THEN i END, CASE WHEN alone THEN i END
  FROM (
    SELECT *, rest = i AND p[i + 2] - p[i + 1] >= {{most}} AS alone FROM (
      SELECT *, CASE WHEN NOT closes THEN begin WHEN p[i + 2] - p[lap + 1] > {{most}} THEN i ELSE lap END AS rest FROM (
        SELECT *, CASE WHEN NOT closes THEN begin WHEN p[i + 1] - p[i] >= {{most}} THEN i
                  ELSE coalesce(list_filter(range(greatest(begin, i - {{keep}}), i), lambda b: p[i + 1] - p[b + 1] <= {{keep}})[1], i - 1) END AS lap FROM (
          SELECT *, i > begin AND p[i + 2] - p[begin + 1] > {{most}} AS closes FROM walk WHERE i < len(n)))))
),
cuts AS (
  SELECT doc_id, b1 AS b, e1 AS e FROM walk WHERE b1 IS NOT NULL UNION ALL SELECT doc_id, b2, b2 + 1 FROM walk WHERE b2 IS NOT NULL
  UNION ALL SELECT doc_id, begin, i FROM walk WHERE i = len(n) AND i > begin
),
texts AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS chunk_num, array_to_string(s[b + 1:e], ' ') AS text FROM cuts JOIN docs USING (doc_id))
SELECT doc_id, CAST(chunk_num AS INT) AS chunk_num, substr(sha256(doc_id || '|' || source || '|||' || text), 1, 24) AS chunk_id, text FROM texts
""".format(most=393, keep=58)


@query(_PACK)
def chunk_pack(spark, d):
    sections = docs(spark, d).select(F.col("source").alias("source_title"), F.lit("libro").alias("source_type"), F.col("doc_id").cast("string").alias("source_path"), F.col("lang").alias("language"), F.lit("").alias("section"), F.lit("").alias("position"), "text", F.lit(None).cast("array<string>").alias("tables"))
    return chunking.chunk_sections(sections, 512, 0.15).select(F.col("source_path").cast("long").alias("doc_id"), "chunk_num", "chunk_id", "text")


_SECTIONS = r"""
WITH cut AS (SELECT page_id, string_split(html, '<p>') AS parts FROM pages),
items AS (SELECT page_id, CAST(i - 1 AS BIGINT) AS seq, trim(regexp_replace(regexp_replace(parts[i], '<[^>]*>?', ' ', 'g'), '\s+', ' ', 'g')) AS t, i FROM cut, unnest(range(1, len(parts) + 1)) u(i)),
marked AS (SELECT *, sum(CASE WHEN (i - 1) % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY seq) AS num FROM items),
secs AS (
  SELECT page_id, CAST(num AS BIGINT) AS section_num, string_agg(CASE WHEN (i - 1) % 3 <> 0 AND t <> '' THEN t END, ' ' ORDER BY seq) AS text, max(i) AS own,
    max(CASE WHEN (i - 1) % 3 = 0 THEN i END) AS head, max(CASE WHEN (i - 1) % 3 = 0 THEN t END) AS htext
  FROM marked GROUP BY page_id, num)
SELECT page_id AS doc, section_num, coalesce(nullif(htext, ''), 'Introduzione') AS title, text, 'p. ' || coalesce(lead(head) OVER (PARTITION BY page_id ORDER BY section_num), own) AS position
FROM secs QUALIFY text <> ''
"""


@query(_SECTIONS)
def sections(spark, d):
    parts = table(spark, d, "pages").select(F.col("page_id").alias("doc"), F.posexplode(F.split("html", "<p>", -1)).alias("seq", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]*>?", " "), r"[ \t\n\f\r]+", " "))
    items = parts.select("doc", F.col("seq").cast("long").alias("seq"), text.alias("text"), F.when(F.col("seq") % 3 == 0, "section_header").otherwise("text").alias("label"), F.lit(1).alias("level"), (F.col("seq") + 1).alias("page_no"), F.lit(None).cast("string").alias("table_md"))
    return chunking.section_items(items).select("doc", "section_num", "title", "text", "position")


@query("SELECT event_id, last_value(CASE WHEN event_id % 5 = 0 THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS title FROM events")
def fill_forward(spark, d):
    w = W.Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_id") % 5 == 0, F.col("props")), ignorenulls=True).over(w).alias("title"))


_UUID = "substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab', CAST((strpos('0123456789abcdef', substr(h,17,1)) - 1) % 4 + 1 AS INT), 1)||substr(h,18,3)||'-'||substr(h,21,12)"


@query(f"""
WITH g AS (SELECT source || '.pdf' AS doc_key, count(*) AS chunks, count(DISTINCT lang) AS sections, min(source) AS title FROM documents GROUP BY source),
s AS (SELECT *, sha1(unhex('{S.URL_NAMESPACE}') || encode('default::' || doc_key)) AS h FROM g)
SELECT {_UUID} AS doc_uuid, doc_key, title, 'PDF' AS doc_type, chunks, sections FROM s
""")
def doc_inventory(spark, d):
    chunks = docs(spark, d).select(F.concat("source", F.lit(".pdf")).alias("source_path"), F.col("source").alias("source_title"), F.col("lang").alias("section"))
    return listing.inventory(chunks, "default")


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS documents FROM documents")
def library_stats(spark, d):
    return listing.library_stats(docs(spark, d).select(F.lit("").alias("source_path"), F.col("source").alias("source_title")))


@query("SELECT source, count(*) AS chunks FROM documents GROUP BY source")
def chunks_per_title(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count("*").alias("chunks"))


# retrieval

_Q = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
_L2 = "list_sum([(CAST(embedding[i] AS DOUBLE) - q[i]) * (CAST(embedding[i] AS DOUBLE) - q[i]) for i in range(1, len(q) + 1)])"
_DOT = "list_sum([CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE) for i in range(1, len(q) + 1)])"
_NORM = "sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding])) * sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in q]))"
_SCORE = "CASE WHEN {d} <= 1 THEN greatest(0.0::DOUBLE, round(1 - {d}, 4)) ELSE round(1 / (1 + {d}), 4) END"


def _knn_sql(distance: str, k: int = 20) -> str:
    return f"SELECT vec_id, round(dist, 6) AS distance, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM (SELECT vec_id, {distance} AS dist FROM embeddings, {_Q}) ORDER BY dist, vec_id LIMIT {k}"


def _knn(spark, d, metric, k=20):
    out = retrieval.knn(vectors(spark, d), query_vector(spark, d), k, "vec_id", "embedding", metric)
    return out.select("vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(_knn_sql(_L2))
def knn_l2(spark, d):
    return _knn(spark, d, "l2")


@query(_knn_sql(f"1 - (2 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({_DOT} / ({_NORM}) + 1) / 2)) - 1)"))
def knn_cosine(spark, d):
    return _knn(spark, d, "cosine")


@query(_knn_sql(f"-({_DOT})"))
def knn_dot(spark, d):
    return _knn(spark, d, "dot")


_COSINE = f"1 - (2 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({_DOT} / ({_NORM}) + 1) / 2)) - 1)"


def _knn_many_sql(distance: str, k: int = 20) -> str:
    asked = "(SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)"
    return f"SELECT query_id, vec_id, round(dist, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM (SELECT query_id, vec_id, {distance} AS dist FROM embeddings, {asked}) QUALIFY rank <= {k}"


def _knn_many(spark, d, metric, k=20):
    asked = vectors(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    out = retrieval.knn_many(vectors(spark, d), asked, k, "vec_id", "embedding", metric)
    return out.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(_knn_many_sql(_L2))
def knn_l2_multi_query(spark, d):
    return _knn_many(spark, d, "l2")


@query(_knn_many_sql(_COSINE))
def knn_cosine_multi_query(spark, d):
    return _knn_many(spark, d, "cosine")


@query(_knn_many_sql(f"-({_DOT})"))
def knn_dot_multi_query(spark, d):
    return _knn_many(spark, d, "dot")


@query(f"SELECT vec_id, {_SCORE.format(d='dist')} AS score FROM (SELECT vec_id, {_L2} AS dist FROM embeddings, {_Q})")
def dense_score(spark, d):
    q = F.lit(query_vector(spark, d))
    return vectors(spark, d).select("vec_id", S.dense_score(S.l2_squared(F.col("embedding"), q)).alias("score"))


@query(f"SELECT vec_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({_DOT} / ({_NORM}) + 1) / 2)), 6) AS similarity FROM embeddings, {_Q}")
def cosine01(spark, d):
    q = F.lit(query_vector(spark, d))
    return vectors(spark, d).select("vec_id", F.round(S.cosine01(F.col("embedding"), q), 6).alias("similarity"))


def _bm25_ctes(asked: str, k: int) -> str:
    return f"""
toks AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS terms FROM documents),
asked AS ({asked}),
stats AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM toks),
post AS (SELECT doc_id, len(terms) AS dl, term, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM toks) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, terms, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 4) AS score
  FROM post JOIN dfs USING (term) JOIN asked USING (term), stats GROUP BY query_id, doc_id),
fts AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= {k})
"""


_ONE = "SELECT DISTINCT 0 AS query_id, unnest(string_split('the and', ' ')) AS term"
_MANY = "SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS term FROM benchmark"


def index_of(spark: SparkSession, d: str) -> fulltext.FullTextIndex:
    """The stored full-text index of the documents as they are now, built by whoever asks first."""
    texts = docs(spark, d)
    return fulltext.FullTextIndex.build(texts, f"{shared.shared_dir(spark)}/fulltext-{fulltext.snapshot_key(texts)}", "doc_id")


def _bm25(spark, d, k):
    return index_of(spark, d).search(spark.createDataFrame([(0, WORDS)], "query_id int, query string"), k)


_TOKENS = "SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS terms FROM documents)"


@query(f"SELECT term, doc_id, CAST(dl AS INT) AS dl, CAST(count(*) AS INT) AS tf FROM ({_TOKENS}) GROUP BY term, doc_id, dl")
def fts_build(spark, d):
    """The postings of the stored index."""
    return index_of(spark, d).postings().select("term", "doc_id", "dl", "tf")


@query(f"SELECT t.term, df, n, round(avgdl, 6) AS avgdl FROM (SELECT term, count(DISTINCT doc_id) AS df FROM ({_TOKENS}) GROUP BY term) t, (SELECT count(DISTINCT doc_id) AS n, (SELECT count(*) FROM ({_TOKENS})) / count(DISTINCT doc_id)::DOUBLE AS avgdl FROM documents)")
def fts_stats(spark, d):
    """Document counts of each term, with the number and mean length of documents."""
    index = index_of(spark, d)
    return index.counts().join(F.broadcast(index.stats())).select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


_CHANGED = "SELECT doc_id, CASE WHEN doc_id % 20 = 3 THEN text || ' the new words' WHEN doc_id % 20 = 7 THEN '' ELSE text END AS text FROM documents WHERE doc_id % 20 <> 11 UNION ALL SELECT -1 - doc_id, text FROM documents WHERE doc_id % 20 = 11"


@query(f"WITH {_bm25_ctes(_MANY, 10).replace('FROM documents)', f'FROM ({_CHANGED}))', 1)} SELECT query_id, doc_id, score, rank FROM fts")
def fts_refresh(spark, d):
    """An index that follows its table: of twenty documents one gets more words, one loses all, and one moves to another id."""
    texts, e = docs(spark, d).select("doc_id", "text"), F.col("doc_id") % 20
    index = fulltext.FullTextIndex.build(texts, f"{shared.shared_dir(spark)}/refreshed-{uuid.uuid4().hex}", "doc_id")
    shared.delete_at_end(spark, index.folder)
    changed = F.when(e == 3, F.concat("text", F.lit(" the new words"))).when(e == 7, "").otherwise(F.col("text"))
    now = texts.where(e != 11).withColumn("text", changed).unionByName(texts.where(e == 11).withColumn("doc_id", -1 - F.col("doc_id")))
    index.refresh(now)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return index.search(asked, 10).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_bm25_ctes(_ONE, 20)} SELECT doc_id, score, rank FROM fts")
def bm25_scan(spark, d):
    """Full-text search without a stored index."""
    found = retrieval.bm25(docs(spark, d), spark.createDataFrame([(0, WORDS)], "query_id int, query string"), 20, "doc_id")
    return found.select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_bm25_ctes(_ONE, 20)} SELECT doc_id, score, rank FROM fts")
def bm25_topk(spark, d):
    return _bm25(spark, d, 20).select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_bm25_ctes(_MANY, 10)} SELECT query_id, doc_id, score, rank FROM fts")
def bm25_multi_query(spark, d):
    return _ranked(spark, d, 10)


def _ranked(spark, d, k):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return index_of(spark, d).search(asked, k).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _found(spark, d, k):
    """query_id, doc_id and rank of the k best of each query, written down: their number is known, so joins needn't exchange the documents."""
    return shared.settled(_ranked(spark, d, k).select("query_id", "doc_id", "rank"))


_CITE = "'[Fonte: ' || source || ', ' || lang || ' (p. ' || (d.doc_id + 1) || ')]' || chr(10) || text"


@query(f"WITH {_bm25_ctes(_MANY, 10)} SELECT query_id, string_agg({_CITE}, chr(10) || chr(10) ORDER BY rank) AS context FROM fts JOIN documents d ON fts.doc_id = d.doc_id GROUP BY query_id")
def citation_context(spark, d):
    """The ten best documents of each query, as the context of an answer."""
    block = S.citation(F.col("source"), F.col("lang"), S.page_position(F.col("doc_id") + 1), F.col("text"))
    found = _found(spark, d, 10).join(docs(spark, d), "doc_id").select("query_id", "rank", block.alias("b"))
    return found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"]), "\n\n").alias("context"))


def _fused(alpha: float, top: int = 20, wide: int = 40) -> str:
    return f"""{_bm25_ctes(_ONE, wide)}, dense AS (SELECT vec_id AS doc_id, dist, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM (SELECT vec_id, {_L2} AS dist FROM embeddings, {_Q}) QUALIFY rank <= {wide}),
j AS (SELECT coalesce(dense.doc_id, fts.doc_id) AS doc_id, dense.rank AS rd, fts.rank AS rf, dense.dist, fts.score FROM dense FULL JOIN fts ON dense.doc_id = fts.doc_id),
r AS (SELECT *, coalesce({alpha}::DOUBLE / (60 + rd), 0) + coalesce((1::DOUBLE - {alpha}::DOUBLE) / (60 + rf), 0) AS rrf FROM j),
fused AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, coalesce(rd, 1000000 + rf)) AS rank FROM r QUALIFY rank <= {top})"""


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {_fused(a)} SELECT {a}::DOUBLE AS alpha, doc_id, round(rrf, 6) AS rrf, rank FROM fused)" for a in (0.0, 0.7, 1.0)))
def rrf_alpha(spark, d):
    dense = retrieval.knn(vectors(spark, d), query_vector(spark, d), 40, "vec_id", "embedding").withColumnRenamed("vec_id", "doc_id")
    text = _bm25(spark, d, 40)
    parts = [retrieval.fuse(dense, text, 20, a, "doc_id").select(F.lit(a).alias("alpha"), "doc_id", F.round("rrf", 6).alias("rrf"), F.col("rank").cast("long").alias("rank")) for a in (0.0, 0.7, 1.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _search(spark, d, mode, alpha=0.7, k=20):
    chunks = docs(spark, d).withColumn("embedding", F.lit(None))
    vecs = vectors(spark, d).withColumnRenamed("vec_id", "doc_id")
    found = retrieval.hybrid_search(chunks, query_vector(spark, d) if mode != "sparse" else None, WORDS, k, mode, alpha, "doc_id", "embedding", vectors=vecs, index=index_of(spark, d))
    return found


def _search_out(found):
    return found.select("doc_id", "source", "dense_score", "bm25_score", F.col("rank").cast("long").alias("rank"))


_DS = f"coalesce({_SCORE.format(d='dist')}, 0.0::DOUBLE)"


@query(f"WITH {_fused(0.7)} SELECT f.doc_id, source, {_DS} AS dense_score, coalesce(score, 0.0::DOUBLE) AS bm25_score, rank FROM fused f JOIN documents d ON f.doc_id = d.doc_id")
def hybrid_search(spark, d):
    return _search_out(_search(spark, d, "hybrid"))


@query(f"WITH {_fused(0.7, wide=20)} SELECT f.doc_id, source, {_DS} AS dense_score, 0.0::DOUBLE AS bm25_score, rank FROM dense f JOIN documents d ON f.doc_id = d.doc_id")
def hybrid_dense_only(spark, d):
    return _search_out(_search(spark, d, "dense"))


@query(f"WITH {_bm25_ctes(_ONE, 20)} SELECT f.doc_id, source, 0.0::DOUBLE AS dense_score, score AS bm25_score, rank FROM fts f JOIN documents d ON f.doc_id = d.doc_id")
def hybrid_sparse_only(spark, d):
    return _search_out(_search(spark, d, "sparse"))


_RERANK = f"""WITH {_fused(0.7)}, c AS (SELECT f.doc_id, f.rank, len(list_intersect(['the', 'tion', 'ing'], toks.terms)) / 3::DOUBLE AS raw FROM fused f JOIN toks ON f.doc_id = toks.doc_id),
o AS (SELECT *, row_number() OVER (ORDER BY raw DESC, rank) AS final_rank FROM c QUALIFY final_rank <= 6)"""


def _reranked(spark, d):
    found = _search(spark, d, "hybrid")
    return retrieval.rerank(found, retrieval.query_coverage("the tion ing", F.col("text")), 6)


@query(f"{_RERANK} SELECT doc_id, round(raw, 4) AS rerank_score, final_rank FROM o")
def rerank_topn(spark, d):
    return _reranked(spark, d).select("doc_id", "rerank_score", F.col("final_rank").cast("long").alias("final_rank"))


@query(f"{_RERANK} SELECT doc_id, rank - final_rank AS rank_delta FROM o")
def rank_delta(spark, d):
    return _reranked(spark, d).select("doc_id", F.col("rank_delta").cast("long").alias("rank_delta"))


def _share_of_terms(query: str, texts: list[str]) -> list[float]:
    """A stand-in for a reranking model: the share of the query's words that a text has."""
    words = set(query.lower().split())
    return [len(words & set(re.split(r"[\W_]+", t.lower()))) / max(1, len(words)) for t in texts]


def _chunks(spark, d):
    """The documents as a chunk table, without vectors."""
    title = F.col("source").alias("source_title")
    kind = F.when(F.col("lang") == "fr", "articolo").when(F.col("lang") == "de", "video").otherwise("libro").alias("source_type")
    return docs(spark, d).select(F.col("doc_id").alias("chunk_id"), "text", title, kind, F.col("lang").alias("section"), S.page_position(F.col("doc_id")).alias("position"))


@query(f"""{_RERANK.replace("['the', 'tion', 'ing']", "['the', 'and']").replace("/ 3::DOUBLE", "/ 2::DOUBLE")}
SELECT o.doc_id AS id, final_rank AS chunk_num, source AS doc_title, CASE lang WHEN 'fr' THEN 'Ricerca' WHEN 'de' THEN 'Manuale' ELSE 'Libro' END AS doc_type, lang AS section,
  CASE WHEN length(text) > 160 THEN substr(text, 1, 160) || '...' ELSE text END AS highlight_snippet, {_SCORE.format(d='fused.dist').join(['coalesce(', ', 0.0::DOUBLE)'])} AS dense_score,
  coalesce(fused.score, 0.0::DOUBLE) AS bm25_score, round(raw, 4) AS rerank_score, o.rank - final_rank AS rank_delta, CAST(trunc({_WORDS} * 1.3::DOUBLE) AS INT) AS token_count,
  CASE WHEN embedding IS NOT NULL THEN '64d' END AS dimensions, CASE WHEN o.doc_id > 0 THEN 'p. ' || o.doc_id ELSE '' END AS char_offset
FROM o JOIN fused ON o.doc_id = fused.doc_id JOIN documents d ON o.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def query_pipeline(spark, d):
    """A question from retrieval over reranking to the view. Vectors are joined to the rows found, not to all texts."""
    chunks, vecs = _chunks(spark, d).withColumnRenamed("chunk_id", "doc_id"), vectors(spark, d).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    found = shared.settled(retrieval.hybrid_search(chunks.withColumn("vector", F.lit(None)), query_vector(spark, d), WORDS, 20, "hybrid", 0.7, "doc_id", vectors=vecs, index=index_of(spark, d)))
    theirs = vecs.join(F.broadcast(found.select("doc_id")), "doc_id", "left_semi")  # found has at most 20 rows
    found = found.join(F.broadcast(theirs), "doc_id", "left").withColumnRenamed("doc_id", "chunk_id")
    shown = retrieval.result_view(retrieval.rerank_or_keep(found, WORDS, _share_of_terms, 6), "none")
    return shown.select("id", F.col("chunk_num").cast("long").alias("chunk_num"), "doc_title", "doc_type", "section", "highlight_snippet", "dense_score", "bm25_score", "rerank_score", F.col("rank_delta").cast("long").alias("rank_delta"), "token_count", "dimensions", "char_offset")


# evaluation

_FLAGS = f"WITH {_bm25_ctes(_MANY, 10)}, flags AS (SELECT query_id AS case_id, rank, coalesce(quality = 1, false) AS relevant FROM fts f LEFT JOIN labels l ON f.doc_id = l.doc_id)"
_PER = "per AS (SELECT case_id, round(coalesce(avg(CASE WHEN relevant THEN good / rank::DOUBLE END), 0), 4) AS precision, max(CASE WHEN relevant THEN 1 ELSE 0 END)::DOUBLE AS recall FROM (SELECT *, sum(CASE WHEN relevant THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY rank) AS good FROM flags) GROUP BY case_id)"


def _flags(spark, d):
    return _found(spark, d, 10).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select(F.col("query_id").alias("case_id"), "rank", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("relevant"))


@query(f"{_FLAGS}, {_PER} SELECT case_id, precision FROM per")
def context_precision(spark, d):
    return evaluation.context_metrics(_flags(spark, d)).select("case_id", "precision")


@query(f"{_FLAGS}, {_PER} SELECT case_id, recall FROM per")
def context_recall(spark, d):
    return evaluation.context_metrics(_flags(spark, d)).select("case_id", "recall")


@query(f"{_FLAGS}, {_PER} SELECT case_id, round((precision + recall) / 2, 4) AS retrieval_match FROM per")
def retrieval_match(spark, d):
    return evaluation.context_metrics(_flags(spark, d)).select("case_id", "retrieval_match")


@query(f"""{_FLAGS}, {_PER}, m AS (SELECT 'precision' AS metric, precision AS value FROM per UNION ALL SELECT 'recall', CASE WHEN case_id % 3 <> 0 THEN recall END FROM per UNION ALL SELECT 'judge', NULL FROM per)
SELECT metric, round(avg(value), 4) AS score, printf('%.1f%% su %d/%d casi', round_even(round(avg(value), 4) * 100, 1), count(value), count(*)) AS delta FROM m GROUP BY metric HAVING count(value) > 0""")
def eval_metrics(spark, d):
    cases = evaluation.context_metrics(_flags(spark, d)).withColumn("recall", F.when(F.col("case_id") % 3 != 0, F.col("recall"))).withColumn("judge", F.lit(None).cast("double"))
    return evaluation.metric_means(cases, ["precision", "recall", "judge"])


#: What each benchmark item is expected to be found in: a title that exists, one with a path and suffix, one that doesn't exist.
_EXPECTED = "CASE item_id % 3 WHEN 0 THEN 'src' || (item_id % 10) WHEN 1 THEN 'docs/SRC' || (item_id % 10) || '.pdf' ELSE 'nowhere.md' END"


@query(f"""WITH {_bm25_ctes(_MANY, 6)},
cases AS (SELECT item_id AS case_id, {_EXPECTED} AS expected FROM benchmark),
there AS (SELECT case_id, expected, EXISTS (SELECT 1 FROM documents d WHERE contains('docs/SRC' || substr(d.source, 4) || '.pdf ' || d.source, expected)) AS present FROM cases),
flags AS (SELECT case_id, rank, source, lower(source) = regexp_replace(regexp_replace(lower(expected), '^.*/', ''), '[.][^.]*$', '') AS relevant FROM there JOIN fts ON query_id = case_id JOIN documents d ON fts.doc_id = d.doc_id WHERE present),
per AS (SELECT case_id, max(CASE WHEN relevant THEN 1 ELSE 0 END) AS found, round(coalesce(avg(CASE WHEN relevant THEN good / rank::DOUBLE END), 0), 4) AS precision
  FROM (SELECT *, sum(CASE WHEN relevant THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY rank) AS good FROM flags) GROUP BY case_id)
SELECT t.case_id, CASE WHEN NOT present THEN 'Skipped' WHEN coalesce(found, 0) = 1 THEN 'Found' ELSE 'Not found' END AS status,
  CASE WHEN present THEN coalesce(precision, 0.0::DOUBLE) END AS precision, CASE WHEN present THEN coalesce(found, 0)::DOUBLE END AS recall,
  CASE WHEN present THEN round((coalesce(precision, 0) + coalesce(found, 0)) / 2, 4) ELSE 0.0::DOUBLE END AS retrieval_match
FROM there t LEFT JOIN per ON t.case_id = per.case_id""")
def eval_cases(spark, d):
    """Cases with an expected document: skipped where it doesn't exist, else judged by the titles among the six best documents."""
    cases = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.expr(_EXPECTED).alias("expected"))
    paths = docs(spark, d).select(F.concat(F.lit("docs/SRC"), F.substring("source", 4, 100), F.lit(".pdf "), "source").alias("path")).distinct()
    found = _found(spark, d, 6).join(docs(spark, d).select("doc_id", "source"), "doc_id").select(F.col("query_id").alias("case_id"), "rank", F.col("source").alias("title"))
    return evaluation.case_results(cases, listing.exists_containing(cases, paths, "expected", "path"), found)


@query("SELECT CASE WHEN count_if(event_type = 'error') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status, count_if(event_type = 'error')::BIGINT AS errors, CASE WHEN count_if(event_type = 'error') > 0 THEN count_if(event_type = 'error') || ' casi non valutabili' END AS error, count_if(event_type = 'click') || '/' || count(*) AS found FROM events")
def job_summary(spark, d):
    status = F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "click", "Found").otherwise("Not found")
    return evaluation.job_summary(table(spark, d, "events").select(F.col("event_id").alias("case_id"), status.alias("status")))


@query("SELECT event_id AS case_id, CASE WHEN event_id % 7 = 0 THEN 0.0::DOUBLE ELSE round(greatest(0, least(event_id % 9 - 1, event_id % 7)) / (event_id % 7)::DOUBLE, 4) END AS faithfulness FROM events")
def faithfulness(spark, d):
    e = F.col("event_id")
    return evaluation.faithfulness(table(spark, d, "events").select(e.alias("case_id"), (e % 9 - 1).alias("supported"), (e % 7).alias("total")))


@query("SELECT source AS case_id, string_agg(lang, ' | ' ORDER BY first, lang) AS titles FROM (SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY source, lang) GROUP BY source")
def distinct_titles(spark, d):
    return listing.ordered_distinct(docs(spark, d), "source", "lang", "doc_id").withColumnRenamed("source", "case_id")


#: Pieces of each page's url: from a place that the id gives on, and as many characters as it says, of which some are changed.
_PIECE = "CASE WHEN page_id % 5 = 4 THEN replace(substr(url, 5 + CAST(page_id % 11 AS INT), 1 + CAST(page_id % 17 AS INT)), '1', '7#') ELSE substr(url, 5 + CAST(page_id % 11 AS INT), 1 + CAST(page_id % 17 AS INT)) END"


@query(f"SELECT page_id, expected, EXISTS (SELECT 1 FROM pages p WHERE contains(p.url, expected)) AS found FROM (SELECT page_id, {_PIECE} AS expected FROM pages) c")
def exists_doc(spark, d):
    """For a piece of each page's url: is it in any url?"""
    pages = table(spark, d, "pages")
    return listing.exists_containing(pages.select("page_id", F.expr(_PIECE).alias("expected")), pages, "expected", "url")


# telemetry


def _samples(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("phase"), F.col("value").alias("seconds"))


_LAT = "lat AS (SELECT event_type AS phase, count(*) AS n, sum(value) AS total, avg(value) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type)"


@query("SELECT event_type AS phase, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def latency_stats(spark, d):
    return evaluation.latency_stats(_samples(spark, d)).withColumns({c: F.round(c, 4) for c in ("total", "mean")})


@query("SELECT event_type AS phase, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY event_type UNION ALL SELECT event_type || ' of all', count(*) FROM events GROUP BY event_type")
def latency_phase(spark, d):
    """One phase; and all of them where the phase isn't known."""
    samples = _samples(spark, d)
    rest = evaluation.latency_stats(samples, "no such phase").select(F.concat("phase", F.lit(" of all")).alias("phase"), "n")
    return evaluation.latency_stats(samples, "view").select("phase", "n").unionByName(rest)


@query("SELECT avg(value) FILTER (value >= 0) AS mean FROM (SELECT CASE WHEN event_id % 5 = 0 THEN -value WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)")
def mean_duration(spark, d):
    value = F.when(F.col("event_id") % 5 == 0, -F.col("value")).when(F.col("event_id") % 7 != 0, F.col("value"))
    return evaluation.mean_duration(table(spark, d, "events").select(value.alias("value")), "value")


@query(f"WITH {_LAT} SELECT '=== Report Latenza RAG ===' || chr(10) || string_agg(printf('Fase: %-15s | Conteggio: %-3d | Media: %.3fs | Min: %.3fs | Max: %.3fs | Totale: %.3fs', phase, n, round_even(mean, 3), round_even(least, 3), round_even(most, 3), round_even(total, 3)), chr(10) ORDER BY phase) AS report FROM lat")
def latency_report(spark, d):
    return evaluation.latency_report(evaluation.latency_stats(_samples(spark, d)))


@query(f"WITH {_LAT} SELECT 'telemetry-' || phase AS id, 'INFO' AS level, CASE phase WHEN 'click' THEN 'Ollama' WHEN 'view' THEN 'CrossEncoder' ELSE 'FastAPI' END AS component, 'Fase ' || chr(39) || phase || chr(39) || ' completata (' || n || ' chiamate)' AS message, CAST(trunc(mean * 1000) AS INT) AS duration_ms FROM lat")
def telemetry_snapshot(spark, d):
    return evaluation.telemetry_snapshot(evaluation.latency_stats(_samples(spark, d)), COMPONENTS)


@query("SELECT event_type AS phase, list_sort(list(value))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95, count(*) AS n FROM events GROUP BY event_type")
def p95(spark, d):
    return evaluation.p95(_samples(spark, d), "phase", "seconds")


@query("SELECT event_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)")
def change_detect(spark, d):
    return listing.changes(table(spark, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type").select("event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_job(spark, d):
    return listing.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT event_id, value FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 200)")
def job_tail(spark, d):
    return listing.tail_then_sort(table(spark, d, "events").select("event_id", "value"), 200, "event_id", "value")


@query("SELECT event_id, least(95.0::DOUBLE, 20 + (event_id % 50) / 49::DOUBLE * 75) AS progress FROM events")
def job_progress(spark, d):
    return table(spark, d, "events").select("event_id", S.progress(F.col("event_id") % 50, F.lit(49)).alias("progress"))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events")
def request_rate(spark, d):
    return evaluation.request_rate(table(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "user_id", "recent")


_RECENT = "list_filter(w, lambda t: a.ts_us - t < 3600000000)"


@query(f"""
WITH RECURSIVE asked AS (SELECT event_id, user_id AS client, epoch_us(ts) AS ts_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
walk AS (
  SELECT event_id, client, ts_us, i, true AS accepted, [ts_us] AS w FROM asked WHERE i = 1
  UNION ALL
  SELECT a.event_id, a.client, a.ts_us, a.i, len({_RECENT}) < 3, CASE WHEN len({_RECENT}) < 3 THEN list_append({_RECENT}, a.ts_us) ELSE {_RECENT} END
  FROM walk JOIN asked a ON a.client = walk.client AND a.i = walk.i + 1
)
SELECT event_id, client, ts_us, accepted FROM walk
""")
def rate_limit(spark, d):
    asked = table(spark, d, "events").select("event_id", F.col("user_id").alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    return requests.rate_limit(asked, limit=3, seconds=3600)


@query("""
SELECT event_id, ticket, accepted FROM (
  SELECT event_id, user_id AS ticket, event_type,
         coalesce(lag(event_type = 'view') OVER t AND epoch_us(ts) - lag(epoch_us(ts)) OVER t <= 7200000000, false) AS accepted
  FROM events WHERE event_type IN ('view', 'click') WINDOW t AS (PARTITION BY user_id ORDER BY ts, event_id)
) WHERE event_type = 'click'
""")
def redeem_tickets(spark, d):
    shown = table(spark, d, "events").where(F.col("event_type").isin("view", "click"))
    rows = shown.select("event_id", F.col("user_id").alias("ticket"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), (F.col("event_type") == "view").alias("issued"))
    return requests.redeem_tickets(rows, seconds=7200).select("event_id", "ticket", "accepted")


_MOVES = ", ".join(f"('{s}', '{e}', '{after}')" for before, e, after in jobs.MOVES for s in before.split())
_STEPS = ["queued", "reading", "parsing", "embedding", "finalizing", "reading", "parsing", "completed"]  # what most jobs log, in turn


@query(f"""
WITH RECURSIVE logged AS (
  SELECT user_id AS job_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
         CASE WHEN event_id % 13 = 0 THEN 'restarted' WHEN event_id % 17 = 0 THEN 'failed' WHEN event_id % 19 = 0 THEN 'unheard of'
              ELSE {_STEPS}[(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % {len(_STEPS)} + 1] END AS event
  FROM events
), moves AS (SELECT * FROM (VALUES {_MOVES}) m(before, event, after)),
walk AS (
  SELECT 0::BIGINT AS i, job_id, NULL::BIGINT AS seq, NULL::VARCHAR AS event, 'none'::VARCHAR AS state, true AS valid FROM (SELECT DISTINCT job_id FROM logged)
  UNION ALL
  SELECT l.i, l.job_id, l.seq, l.event, coalesce(m.after, w.state), m.after IS NOT NULL
  FROM walk w JOIN logged l ON l.job_id = w.job_id AND l.i = w.i + 1 LEFT JOIN moves m ON m.before = w.state AND m.event = l.event
)
SELECT job_id, seq, event, state, valid FROM walk WHERE i > 0
""")
def job_states(spark, d):
    """The state of each job after each of its events, and which of these weren't allowed."""
    e, place = F.col("event_id"), F.row_number().over(W.Window.partitionBy("user_id").orderBy("event_id")) - 1
    step = F.element_at(F.lit(_STEPS), (place % len(_STEPS)).cast("int") + 1)
    event = F.when(e % 13 == 0, "restarted").when(e % 17 == 0, "failed").when(e % 19 == 0, "unheard of").otherwise(step)
    return jobs.job_states(table(spark, d, "events").select(F.col("user_id").alias("job_id"), e.alias("seq"), event.alias("event")))


# stored chunks


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value + 1 ELSE value END AS value FROM events UNION ALL SELECT event_id + 10000000, value + 1 FROM events WHERE event_id % 4 = 0")
def upsert_merge(spark, d):
    """A stored table of the events, a quarter of whose rows are replaced and added to; older rows of the same keys come along."""
    stored = table(spark, d, "events").select("event_id", "value")
    changed = stored.where("event_id % 4 = 0").withColumn("value", F.col("value") + 1)
    more = changed.withColumn("event_id", F.col("event_id") + 10_000_000)
    older = changed.withColumn("value", F.lit(-1.0)).withColumn("written", F.lit(0))
    kept = BucketedTable(spark, f"{shared.shared_dir(spark)}/upsert-{uuid.uuid4().hex}", T.StructType([stored.schema[c] for c in ("event_id", "value")]), "event_id")
    shared.delete_at_end(spark, kept.folder)
    kept.upsert(stored)
    kept.upsert(changed.unionByName(more).withColumn("written", F.lit(1)).unionByName(older), "written")
    return kept.read()


@query("SELECT vec_id, CAST((row_number() OVER (ORDER BY vec_id) - 1) // 32 AS INT) AS batch FROM embeddings")
def batch_number(spark, d):
    return listing.batch_number(vectors(spark, d).select("vec_id"), "vec_id").select("vec_id", "batch")


# the map of vectors


@query("SELECT vec_id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER () + 1e-6::DOUBLE) * 70 + 15, 2) AS x FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)")
def scale_coords(spark, d):
    x = vectors(spark, d).select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    bounds = x.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return x.join(F.broadcast(bounds)).select("vec_id", listing.scale(F.col("x"), F.col("low"), F.col("high")).alias("x"))


@query()
def kmeans_project(spark, d):
    return projection.project(vectors(spark, d), "vec_id", "embedding")


@query("SELECT vec_id, source, coalesce(d.source, 'Sconosciuto') AS title FROM (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 500) e LEFT JOIN documents d ON e.vec_id = d.doc_id + 5")
def point_attributes(spark, d):
    points = listing.sample(vectors(spark, d).select("vec_id"), 500, "vec_id")
    named = docs(spark, d).select((F.col("doc_id") + 5).alias("vec_id"), "source")
    return points.join(named, "vec_id", "left").select("vec_id", "source", F.coalesce("source", F.lit("Sconosciuto")).alias("title"))


@query("SELECT vec_id, CAST(i - 1 AS INT) AS pos, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST(embedding[i] AS DOUBLE) + 0.5::DOUBLE)) AS shade FROM embeddings, unnest(range(1, 65)) u(i) WHERE i <= len(embedding)")
def embedding_cells(spark, d):
    return vectors(spark, d).select("vec_id", F.posexplode(F.slice("embedding", 1, 64)).alias("pos", "c")).select("vec_id", "pos", S.cell(F.col("c").cast("double")).alias("shade"))


@query("SELECT label, 'C' || label AS cluster FROM (SELECT DISTINCT label FROM embeddings) ORDER BY label")
def cluster_names(spark, d):
    named = vectors(spark, d).select("label", F.concat(F.lit("C"), F.col("label").cast("string")).alias("cluster")).distinct()
    return named.orderBy(F.regexp_extract("cluster", r"\d+", 0).cast("int"))


# file names, uploads, the log of jobs, what a view shows

_SUFFIXES = [".pdf", ".DOCX", ".python", ".yml", ".md", ".json", "", ".Markdown"]
_PATHS = f"SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'units/Calculus PDF.json' ELSE url || ' a_b' || {_SUFFIXES}[page_id % 8 + 1] END AS path FROM pages"


def _paths(spark, d):
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("page_id") % 8 + 1).cast("int"))
    path = F.when(F.col("page_id") % 11 == 0, F.lit("units/Calculus PDF.json")).otherwise(F.concat("url", F.lit(" a_b"), suffix))
    return table(spark, d, "pages").select("page_id", path.alias("path"))


@query(rf"""
WITH p AS ({_PATHS}), b AS (SELECT page_id, path, regexp_extract(path, '[^/]*$') AS b FROM p WHERE regexp_extract(path, '[^/]*$') <> 'Calculus PDF.json')
SELECT page_id, replace(CASE WHEN regexp_matches(b, '^.+\.[^.]+$') THEN regexp_replace(b, '\.[^.]*$', '') ELSE b END, '_', ' ') AS title,
  CASE WHEN upper(regexp_extract(b, '\.([^.]+)$', 1)) IN ('PDF', 'DOCX', 'PYTHON', 'YAML', 'MARKDOWN', 'JSON') THEN upper(regexp_extract(b, '\.([^.]+)$', 1)) ELSE 'PDF' END AS doc_type,
  regexp_replace(path, '\s+', '_', 'g') AS download
FROM b
""")
def file_names(spark, d):
    """Titles, kinds and names for a download of files by their paths, without those that are never ingested."""
    kept = _paths(spark, d).where(~S.base_name(F.col("path")).isin(files.EXCLUDED))
    return kept.select("page_id", S.title_of(F.col("path")).alias("title"), S.doc_type(F.col("path")).alias("doc_type"), S.file_name(F.col("path")).alias("download"))


_NOW = 1_705_000_000


@query(f"SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE greatest(0, {_NOW} - CAST(floor(epoch(ts)) AS BIGINT)) END AS age, strftime(ts, '%Y-%m-%d') AS day FROM events")
def event_age(spark, d):
    """Ages at a given time, 0 where the time isn't known, and days."""
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    known = F.when(F.col("event_id") % 9 != 0, seconds)
    return table(spark, d, "events").select("event_id", S.age_seconds(F.lit(_NOW).cast("long"), known).cast("long").alias("age"), S.day_of(seconds).alias("day"))


@query("SELECT doc_id // 5 AS doc, coalesce(sum(CASE WHEN doc_id % 5 < 3 THEN length(text) END), 0) >= 2000 AS has_text FROM documents GROUP BY 1")
def text_layer(spark, d):
    """Is there text enough on the first three pages? Five documents are the pages of one."""
    pages = docs(spark, d).select(F.expr("doc_id div 5").alias("doc"), (F.col("doc_id") % 5 + 1).alias("page"), "text")
    return files.has_text_layer(pages, 2000)


@query("SELECT source AS request, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, max(strlen(text)) AS largest, count(*) <= 500 AND max(strlen(text)) <= 262144000 AND sum(strlen(text)) <= 100000 AS admitted FROM documents GROUP BY 1")
def upload_sums(spark, d):
    """Files and bytes of each request, and which of them keep the ceilings."""
    uploads = docs(spark, d).select(F.col("source").alias("request"), F.octet_length("text").cast("long").alias("bytes"))
    return files.request_sums(uploads, "request", max_payload_bytes=100_000)


@query("SELECT CAST(count(*) AS BIGINT) AS active FROM events WHERE event_type IN ('click', 'view')")
def active_jobs(spark, d):
    return listing.active_jobs(_logged(spark, d))


def _logged(spark, d):
    """The events as jobs, with states and a field that is made from others."""
    state = F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "in_progress").otherwise("completed")
    return table(spark, d, "events").select(F.col("event_id").alias("job_id"), state.alias("status"), "user_id", (F.col("value") * 2).alias("progress"))


@query("SELECT event_id AS job_id, CASE WHEN event_type IN ('click', 'view') THEN 'interrupted' ELSE 'completed' END AS status, user_id FROM events ORDER BY event_id DESC LIMIT 200")
def job_log(spark, d):
    """The log after a restart: its last 200 jobs, of which those that were in flight are interrupted."""
    folder = f"{shared.shared_dir(spark)}/job-log-{shared.new_name()}"
    shared.delete_at_end(spark, folder)
    log.write(_logged(spark, d), folder, "job_id", derived=["progress"])
    return log.read(spark, folder)


@query("SELECT 'job' AS kind, event_id FROM (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 8) UNION ALL SELECT 'notification', event_id FROM (SELECT event_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 20)")
def shown_rows(spark, d):
    """What a view shows: the newest 8 jobs and the newest 20 notifications."""
    events = table(spark, d, "events").select("event_id", "event_type", "ts")
    shown = lambda kind, rows: rows.select(F.lit(kind).alias("kind"), "event_id")
    return shown("job", listing.newest(events, listing.SHOWN_JOBS, "ts", "event_id")).unionByName(shown("notification", listing.newest(events.where("event_type = 'click'"), listing.SHOWN_NOTIFICATIONS, "ts", "event_id")))


@query(r"SELECT 'chunk_' || (doc_id + 1) || '_' || regexp_replace(source || ' of  ' || lang, '\s+', '_', 'g') || '.json' AS name, CAST(to_json({'chunk_num': doc_id + 1, 'doc_title': source || ' of  ' || lang, 'text': text}) AS VARCHAR) AS content FROM documents")
def chunk_download(spark, d):
    """Each chunk as a JSON file with a name."""
    return listing.download(docs(spark, d).select((F.col("doc_id") + 1).alias("chunk_num"), F.concat("source", F.lit(" of  "), "lang").alias("doc_title"), "text"))


@query(f"WITH {_fused(0.7)} SELECT doc_id, {_DS} AS rerank_score, rank AS final_rank, 0 AS rank_delta FROM fused WHERE rank <= 6")
def cut_by_rank(spark, d):
    """A search that isn't reranked: its first six."""
    return retrieval.cut(_search(spark, d, "hybrid"), 6).select("doc_id", "rerank_score", F.col("final_rank").cast("long").alias("final_rank"), "rank_delta")
