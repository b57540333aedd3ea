"""Hooks for models: embedders, generators and judges are functions of batches, called inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import scalars as S

#: What is shown instead of a model's answer, and what a judge is told.
NO_CONTEXT = "Il materiale a disposizione non copre questo punto: nessun passaggio pertinente trovato."
FAILED = "Errore durante la generazione LLM (%s). Ecco i passaggi principali trovati nel contesto:\n"
JUDGE_PROMPT = (
    "Sei un valutatore RAG rigoroso. Devi stabilire se la risposta è supportata dal contesto fornito. Restituisci SOLO JSON valido con i campi "
    "supported_claims e total_claims, entrambi interi. Conta le affermazioni tecniche verificabili; un'affermazione è supported solo se è "
    "direttamente supportata dal contesto. Non premiare informazioni esterne."
)
JUDGED_CONTEXT, JUDGED_ANSWER = 24_000, 12_000  # characters that a judge reads


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 32, load: Callable[[], Callable] | None = None) -> DataFrame:
    """rows with a vector of their text, `batch` texts a call; as many vectors as texts must come back.

    load: makes the embedder, once in each task, where it is a client that can't travel.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = load() if load else embedder
        for frame in frames:
            vectors: list[list[float]] = []
            texts = frame["text"].fillna("").tolist()
            for i in range(0, len(texts), batch):
                made = use(texts[i : i + batch])
                if len(made) != len(texts[i : i + batch]):
                    raise ValueError("as many vectors as texts must come back")
                vectors += made
            yield frame.assign(vector=vectors)

    base = rows.drop("vector")
    return base.mapInPandas(run, T.StructType([*base.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))


def answer_prompt(chunks: DataFrame, question: str, rank: str = "rank") -> DataFrame:
    """One row, n_chunks and the user's message with the chunks in rank order; chunks are a ranking's few."""
    block = S.citation(*map(F.col, ("source_title", "section", "position", "text")))
    return chunks.agg(F.count("*").alias("n_chunks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context")).select("n_chunks", S.question_prompt(F.col("context"), F.lit(question)).alias("prompt"))


def answer(prompt: DataFrame, generator: Callable[[str], str]) -> DataFrame:
    """The answer to a prompt; without chunks a fixed sentence and no call. An empty answer raises."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [generator(p) if n else NO_CONTEXT for n, p in zip(frame["n_chunks"], frame["prompt"], strict=True)]
            if not all(out):
                raise ValueError("empty answer")
            yield pd.DataFrame({"answer": out})

    return prompt.mapInPandas(run, "answer string")


def fallback_line(title: Column, text: Column) -> Column:
    """The line shown for a chunk when no model answers."""
    return F.concat(F.lit("- ["), S.text_of(title), F.lit("] "), F.substring(S.text_of(text), 1, 120), F.lit("..."))


def score(candidates: DataFrame, query: str, reranker: Callable[[str, list[str]], list[float]], text_col: str = "text") -> DataFrame:
    """Candidates, a ranking's few, with `raw`, the reranker's score of their text; all null where it fails or returns another number."""
    columns = candidates.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames) or [pd.DataFrame(columns=columns)])
        if len(frame):
            try:
                made = reranker(query, frame[text_col].fillna("").tolist())
                made = [float(x) for x in (made if isinstance(made, (list, tuple)) else [made])]
            except Exception:  # the ranking before stays
                made = []
            yield frame.assign(raw=made if len(made) == len(frame) else [None] * len(frame)).astype({"raw": "float64"})

    return candidates.repartition(1).mapInPandas(run, T.StructType([*candidates.schema.fields, T.StructField("raw", T.DoubleType())]))


def answer_or_fallback(chunks: DataFrame, question: str, generator: Callable[[str], str], rank: str = "rank") -> DataFrame:
    """One row, answer and failed: a model's answer to the question over chunks in rank order. Without chunks the fixed sentence; where the
    model fails or says nothing, its error and a line for each chunk."""
    line = fallback_line(F.col("source_title"), F.col("text"))
    lines = chunks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    asked = answer_prompt(chunks, question, rank).join(lines)  # one row each

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for n, prompt, shown in zip(frame["n_chunks"], frame["prompt"], frame["lines"], strict=True):
                try:
                    told = generator(prompt) if n else NO_CONTEXT
                    if not told:
                        raise ValueError("empty answer")
                    out.append((told, False))
                except Exception as e:
                    out.append((FAILED % e + shown, True))
            yield pd.DataFrame(out, columns=["answer", "failed"])

    return asked.mapInPandas(run, "answer string, failed boolean")


def judge(cases: DataFrame, generator: Callable[[str, str], str]) -> DataFrame:
    """cases (case_id, query, answer, contexts array<string>): case_id, supported, total, error. generator(system, user) answers in JSON.

    A blank answer has no claims and isn't judged. Where the judge fails or gives no JSON object, error says so and the counts are null.
    """
    context = F.substring(F.array_join("contexts", "\n\n"), 1, JUDGED_CONTEXT)
    told = F.concat(F.lit("DOMANDA:\n"), S.text_of("query"), F.lit("\n\nRISPOSTA:\n"), F.substring(S.text_of("answer"), 1, JUDGED_ANSWER), F.lit("\n\nCONTESTO:\n"), context)
    asked = cases.select("case_id", F.when(S.strip(S.text_of("answer")) != "", told).alias("prompt"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw, errors = [], []
            for prompt in frame["prompt"]:
                try:
                    raw.append(generator(JUDGE_PROMPT, prompt) if isinstance(prompt, str) else '{"total_claims": 0}')
                    errors.append(None)
                except Exception as e:
                    raw.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pd.DataFrame({"case_id": frame["case_id"].array, "raw": raw, "error": pd.array(errors, dtype=object)})

    answered = asked.mapInPandas(run, T.StructType([cases.schema["case_id"], T.StructField("raw", T.StringType()), T.StructField("error", T.StringType())]))
    found = S.json_object(F.col("raw"))
    count = lambda name: F.coalesce(F.get_json_object(found, f"$.{name}").try_cast("int"), F.lit(0))
    total = F.greatest(F.lit(0), count("total_claims"))
    return answered.select(
        "case_id", F.when(found.isNotNull(), F.greatest(F.lit(0), F.least(total, count("supported_claims")))).alias("supported"), F.when(found.isNotNull(), total).alias("total"),
        F.coalesce("error", F.when(found.isNull(), F.lit("Il giudice LLM non ha restituito un JSON valido"))).alias("error"),
    )


def count_tokens(rows: DataFrame, load: Callable[[], Callable[[str], int]], text_col: str = "text") -> DataFrame:
    """rows with n_tokens of their text by a tokenizer that load() makes once in each task; where it can't be made, the estimate."""
    base = rows.drop("n_tokens").withColumn("_estimate", S.token_estimate(F.col(text_col)).cast("long"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            use = load()
        except Exception:
            use = None
        for frame in frames:
            counted = [use(t) for t in frame[text_col].fillna("")] if use else frame["_estimate"].to_list()
            yield frame.drop(columns="_estimate").assign(n_tokens=counted)

    return base.mapInPandas(run, T.StructType([*rows.drop("n_tokens").schema.fields, T.StructField("n_tokens", T.LongType())]))
