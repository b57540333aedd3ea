"""The operators' queries, as the driver calls them, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.bpe import bpe_round_trip
from quern.llm.chat import format_chat
from quern.llm.collocations import collocations
from quern.llm.decontaminate import contaminated
from quern.llm.exact_dedup import exact_duplicates
from quern.llm.html_text import main_text
from quern.llm.licenses import license_scan
from quern.llm.lm import lm_score
from quern.llm.near_dedup import near_duplicates
from quern.llm.packing import pack_documents
from quern.llm.quality import quality_scores
from quern.llm.ranked import ranked_search
from quern.llm.sharding import shard


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizers keep a file: the default of the operators' path parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return format_chat(turns.unionByName(extra), tokenizer_path("byte_bpe_50k.json"))


def op6_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"), shards=16)


def op9_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op11_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_bpe_round_trip, op2_near_duplicates, op3_license_scan, op4_lm_score, op5_chat_format, op6_quality_score, op7_exact_duplicates, op8_shards, op9_contaminated, op10_main_text,
        op11_pack_documents, op12_ranked_search, op13_collocations,
    ]
    return {f.__name__: f for f in found}


_OP2 = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS line, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), places AS (
  SELECT line, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p AS shingle
  FROM (SELECT line, unnest(words) AS w, unnest(range(len(words))) AS place FROM texts WHERE len(words) >= 5) WINDOW p AS (PARTITION BY line ORDER BY place)
), shingles AS (
  SELECT DISTINCT line, shingle FROM places WHERE shingle IS NOT NULL
  UNION ALL SELECT line, array_to_string(words, ' ') FROM texts WHERE len(words) BETWEEN 1 AND 4
), sets AS (
  SELECT line, doc_id, count(shingle) AS n, sha256(string_agg(shingle, chr(10) ORDER BY shingle)) AS digest
  FROM texts LEFT JOIN shingles USING (line) GROUP BY line, doc_id
), classes AS (
  SELECT digest, min(doc_id) AS class_id, min(line) AS line, any_value(n) AS n FROM sets WHERE n > 0 AND doc_id IS NOT NULL GROUP BY digest
), class_shingles AS (
  SELECT digest, n, shingle FROM classes JOIN shingles USING (line)
), links AS (
  SELECT a.digest AS one, b.digest AS other FROM class_shingles a JOIN class_shingles b ON a.shingle = b.shingle AND a.digest <> b.digest
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.digest, b.digest, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
  UNION SELECT a.digest, b.digest FROM sets a JOIN sets b ON a.doc_id = b.doc_id AND a.digest <> b.digest WHERE a.n > 0 AND b.n > 0
), reach AS (
  SELECT digest AS one, digest AS other FROM classes
  UNION SELECT reach.one, links.other FROM reach JOIN links ON reach.other = links.one
), components AS (
  SELECT one AS digest, min(class_id) AS component_id FROM reach JOIN classes ON other = digest GROUP BY one
)
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(doc_id = coalesce(component_id, doc_id), true) AS kept
FROM sets LEFT JOIN components ON sets.digest = components.digest AND n > 0 AND doc_id IS NOT NULL
"""

_OP5 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), shown AS (
  SELECT *, role = 'assistant' AS learned,
         length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:/?s>|/?(?:INST|SYS|ASST|ROLE)\]|NAME\])')) AS text_chars,
         CASE WHEN role IN ('user', 'assistant') THEN length('[INST][/INST]') WHEN role = 'system' THEN length('[SYS][/SYS]')
              ELSE length('[ROLE][NAME][/ROLE]') + length(role) + len(regexp_extract_all(role, '[<\[]\\*(?:/?s>|/?(?:INST|SYS|ASST|ROLE)\]|NAME\])')) END AS mark_chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (learned), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (learned), '')) AS loss_sha256,
       CAST(length('<s>') + sum(text_chars + mark_chars + length('</s>')) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""

_OP7 = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size, max(chars) OVER (PARTITION BY text_sha256) AS most
  FROM rows
)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id AND chars = most) AS kept, text_sha256, CAST(chars AS BIGINT) AS chars FROM ranked
"""

_OP9 = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM benchmark WHERE item_id IS NOT NULL
), texts AS (
  SELECT row_number() OVER () AS line, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM documents WHERE doc_id IS NOT NULL
), item_words AS (
  SELECT item_id, words AS item, unnest(words) AS w, unnest(range(len(words))) AS place FROM items WHERE len(words) >= 8
), text_words AS (
  SELECT line, unnest(words) AS w, unnest(range(len(words))) AS place FROM texts WHERE len(words) >= 8
), near AS (
  -- the fewest words that may agree: 0.8 of 8
  SELECT line, item_id, item, t.place - i.place AS diagonal FROM text_words t JOIN item_words i USING (w) GROUP BY ALL HAVING count(*) >= 7
), compared AS (
  SELECT doc_id, item_id, diagonal, len(item) AS item_words, least(13, len(item)) AS width,
         list_transform(range(len(item)), lambda k: CASE WHEN k + diagonal >= 0 AND texts.words[k + diagonal + 1] = item[k + 1] THEN 1 ELSE 0 END) AS agree
  FROM near JOIN texts USING (line)
), verified AS (
  SELECT doc_id, item_id, item_words, diagonal, max(list_sum(agree)) AS agreeing FROM compared
  WHERE len(list_filter(range(item_words - width + 1), lambda b: list_sum(agree[b + 1:b + width]) >= 0.8 * width)) > 0 GROUP BY ALL
)
SELECT doc_id, item_id, CAST(item_words AS BIGINT) AS item_words, CAST(max(agreeing) AS BIGINT) AS matched, count(*) AS diagonals
FROM verified GROUP BY doc_id, item_id, item_words
"""

_OP12 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS line, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), items AS (
  SELECT row_number() OVER () AS item, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM texts WHERE len(terms) > 0
), asked AS (
  SELECT item, term, count(*) AS repeats FROM (SELECT item, unnest(terms) AS term FROM items) GROUP BY ALL
), postings AS (
  SELECT line, doc_id, n, term, count(*) AS tf FROM (SELECT line, doc_id, len(terms) AS n, unnest(terms) AS term FROM texts)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, totals GROUP BY term, n_docs
), scored AS (
  SELECT item, line, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // words)))) AS BIGINT) AS score
  FROM postings JOIN weights USING (term) JOIN asked USING (term), totals GROUP BY item, line, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score
FROM scored JOIN items USING (item) WHERE score > 0 QUALIFY rank <= 20
"""

_OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), spoken AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM spoken GROUP BY lang
), phrases AS (
  SELECT lang, words[i + 1:i + k] AS phrase, k, count(*) AS f FROM (
    SELECT lang, words, k, unnest(range(len(words) - k + 1)) AS i FROM spoken, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(words) >= k
  ) GROUP BY ALL
), candidates AS (
  SELECT lang, phrase, k, f AS a FROM phrases WHERE k > 1 AND f >= 30
), inside AS (
  SELECT lang, phrase[i + 1:i + size] AS phrase, max(a) AS most FROM (
    SELECT lang, phrase, a, size, unnest(range(k - size + 1)) AS i FROM candidates, (SELECT unnest([2, 3]) AS size) WHERE size < k
  ) GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, a, p.f AS l, q.f AS r, cut, CAST((2000000::HUGEINT * a) // (p.f + q.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c JOIN phrases p ON p.lang = c.lang AND p.phrase = c.phrase[1:cut] JOIN phrases q ON q.lang = c.lang AND q.phrase = c.phrase[cut + 1:c.k]
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), named AS (
  SELECT s.lang, array_to_string(s.phrase, ' ') AS phrase, a, l, r, n, score
  FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase JOIN totals t ON t.lang = s.lang WHERE coalesce(100 * most < 80 * a, true)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM named QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_ranked_search": _OP12, "op13_collocations": _OP13, "op2_near_duplicates": _OP2, "op5_chat_format": _OP5, "op7_exact_duplicates": _OP7, "op9_contaminated": _OP9}
