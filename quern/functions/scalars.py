"""Scalar functions over columns. All stay in the JVM; nulls count as empty strings unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space as Python's str.strip() and str.split() see it.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Fixed value: what is no white space; ASCII, which is most of a text, is tried first.
NO_SPACE = SPACE.replace("[", "[!-~[^", 1) + "]"
#: Fixed value: a sentence ends at .!? before white space and one of these.
SENTENCE = r"(?<=[.!?])\s+(?=[A-ZÀÈÉÌÒÙ0-9])"
#: Fixed value: the namespace of name-based identifiers of URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: Fixed value: suffixes that name a document type.
DOC_TYPES = ["PDF", "DOCX", "PYTHON", "YAML", "MARKDOWN", "JSON"]
#: Parts of keys whose values are secret, and keys that name proxies.
SECRET_PARTS = ["token", "secret", "password", "passwd", "api_key", "apikey", "authorization", "cookie", "credential", "private_key"]
PROXY_KEYS = ["http_proxy", "https_proxy", "all_proxy"]
#: Fixed value: what a model is told before a question.
SYSTEM_PROMPT = """Sei un assistente che risponde SOLO in base al contesto fornito qui sotto, estratto da libri e articoli scientifici.

Regole:
1. Se il contesto non contiene l'informazione richiesta, dichiaralo esplicitamente ("Il materiale a disposizione non copre questo punto") invece di rispondere a memoria.
2. Ogni affermazione tecnica deve essere riconducibile a un passaggio del contesto: cita la fonte tra parentesi nel formato (Fonte, Sezione) dopo l'affermazione che supporta.
3. Non mescolare informazioni da fonti diverse in un'unica affermazione senza distinguerle.
4. Rispondi in italiano, in modo tecnico e diretto, senza preamboli."""


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at the ends; texts whose first and last characters are none aren't searched."""
    return F.when(F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1)).rlike(SPACE), F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")).otherwise(c)


def sentences(c: Column) -> Column:
    """Sentences of a text, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text_of(c), SENTENCE, -1), strip), lambda s: s != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(text_of(c), F.lit(NO_SPACE + "+"))


def token_estimate(c: Column) -> Column:
    return (word_count(c) * F.lit(1.3)).cast("int")


def chunk_id(path: Column, title: Column, section: Column, position: Column, text: Column) -> Column:
    """The first 24 hex digits of SHA-256 over the joined fields."""
    return F.substring(F.sha2(F.concat_ws("|", *[text_of(c) for c in (path, title, section, position, text)]), 256), 1, 24)


def name_uuid(name: Column) -> Column:
    """The version-5 identifier of a name in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.replace(text_of(path), F.lit("\\"), F.lit("/")), "[^/]*$", 0)


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def title_of(path: Column) -> Column:
    return F.replace(stem(path), F.lit("_"), F.lit(" "))


def doc_type(path: Column) -> Column:
    suffix = F.upper(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))
    return F.when(suffix.isin(DOC_TYPES), suffix).otherwise(F.lit("PDF"))


def file_size(n: Column) -> Column:
    """1023 B, 1.00 KB, ... TB; ties round to the even digit."""
    units = ["KB", "MB", "GB", "TB"]
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in enumerate(units, 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.2f {unit}", F.bround(n.cast("double") / 1024**k, 2))).otherwise(out)
    return out


def normal_name(c: Column) -> Column:
    """Base name without suffix, lower case, everything but letters and digits an underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(stem(c)), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")


def names_match(a: Column, b: Column) -> Column:
    """Normalised names are equal or one ends with the other; an empty name matches nothing."""
    a, b = normal_name(a), normal_name(b)
    return (a != "") & (b != "") & ((a == b) | F.endswith(a, b) | F.endswith(b, a))


def snippet(c: Column, n: int = 160) -> Column:
    c = text_of(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def page_position(page: Column) -> Column:
    return F.when(page > 0, F.concat(F.lit("p. "), page.cast("string"))).otherwise(F.lit(""))


def citation(title: Column, section: Column, position: Column, text: Column) -> Column:
    """[Fonte: title, section (position)] and the text on the next line; empty parts are left out."""
    section, position = text_of(section), text_of(position)
    label = F.concat(text_of(title), F.when(section != "", F.concat(F.lit(", "), section)).otherwise(""), F.when(position != "", F.concat(F.lit(" ("), position, F.lit(")"))).otherwise(""))
    return F.concat(F.lit("[Fonte: "), label, F.lit("]\n"), text_of(text))


def question_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Contesto:\n\n"), text_of(context), F.lit("\n\nDomanda: "), text_of(question))


def chat_messages(context: Column, question: Column) -> Column:
    """The messages of a request: array of (role, content), the system's first."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", question_prompt(context, question)))


def json_object(raw: Column, strict: bool = False) -> Column:
    """The JSON object of an answer: the whole text without its fence, else the outermost {...}, whichever parses first.

    Without one, null; if strict, an error in the job.
    """
    bare = strip(text_of(raw))
    bare = F.when(F.startswith(bare, F.lit("```")), F.regexp_replace(strip(F.regexp_replace(bare, "^`+|`+$", "")), f"(?i)^json{SPACE}*", "")).otherwise(bare)
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    # one element of an array: a parser of the object alone would let anything follow it
    parses = lambda c: F.startswith(c, F.lit("{")) & (F.coalesce(F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))), F.lit(0)) == 1)
    found = F.when(parses(bare), bare).when(parses(inner), inner)
    return F.coalesce(found, F.raise_error(F.lit("no JSON object in the answer")).cast("string")) if strict else found


def file_name(c: Column) -> Column:
    """White space as underscores, a run as one."""
    return F.regexp_replace(text_of(c), f"{SPACE}+", "_")


def age_seconds(now: Column, then: Column) -> Column:
    """Whole seconds between two epoch times, none negative; an unknown time is now."""
    return F.greatest(F.lit(0), (now - F.coalesce(then, now)).cast("long"))


def day_of(seconds: Column) -> Column:
    """The date of an epoch time, in the session's zone."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def clean_path(path: Column) -> Column:
    """Path without empty, . and .. parts."""
    return F.array_join(F.filter(F.split(F.replace(text_of(path), F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", "..")), "/")


def redact(fields: Column, limit: int = 4096) -> Column:
    """A map with secrets and proxies masked and long values cut."""
    def one(key: Column, value: Column) -> Column:
        k = F.lower(key)
        secret = reduce(lambda a, b: a | b, [F.contains(k, F.lit(p)) for p in SECRET_PARTS])
        return F.when(k.isin(PROXY_KEYS), F.lit("<REDACTED_PROXY>")).when(secret, F.lit("<REDACTED>")).when(F.octet_length(value) <= limit, value).when(F.length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit("...<truncated>"))).otherwise(value)

    return F.transform_values(fields, one)


# vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def cosine01(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2 within 0..1; 0 for empty vectors, unequal lengths or a zero norm."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    mapped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.try_divide(dot(a, b), norms) + 1) / 2))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0), mapped).otherwise(0.0)


def dense_score(distance: Column) -> Column:
    """1 - d up to a distance of 1, else 1 / (1 + d), to 4 digits. Not monotone: rank by distance."""
    return F.when(distance <= 1, F.greatest(F.lit(0.0), F.round(1 - distance, 4))).otherwise(F.round(1 / (1 + distance), 4))


def rrf(rank_dense: Column, rank_text: Column, alpha: float, k: int = 60) -> Column:
    return F.coalesce(F.lit(alpha) / (k + rank_dense), F.lit(0.0)) + F.coalesce(F.lit(1.0 - alpha) / (k + rank_text), F.lit(0.0))


def cell(v: Column) -> Column:
    """An embedding component as a shade from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v + 0.5))


def progress(created: Column, total: Column) -> Column:
    """Of a job's chunks, in percent: from 20 to 95."""
    return F.least(F.lit(95.0), 20 + F.try_divide(created.cast("double"), total.cast("double")) * 75)


def file_progress(done: Column, total: Column) -> Column:
    """Of a job's files, in percent, to one digit."""
    return F.bround(done.cast("double") / F.greatest(F.lit(1), total).cast("double") * 100, 1)
