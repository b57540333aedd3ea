"""Retrieval quality and latency statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quern.functions import scalars as S
from quern.operators.skew import join_in_parts
from quern.sources.shared import settled

GRID, ROUNDS = 100, 20  # quantiles of a round, and rounds, of which each leaves a few hundredths
FEW = 10_000  # rows of a group that are counted out in one task


def context_metrics(flags: DataFrame) -> DataFrame:
    """flags (case_id, rank, relevant boolean): case_id, precision (mean of precision at relevant ranks), recall, retrieval_match."""
    running = F.sum(F.col("relevant").cast("int")).over(W.Window.partitionBy("case_id").orderBy("rank").rowsBetween(W.Window.unboundedPreceding, 0))
    at = flags.withColumn("at", F.when(F.col("relevant"), running / F.col("rank")))
    per = at.groupBy("case_id").agg(F.round(F.coalesce(F.avg("at"), F.lit(0.0)), 4).alias("precision"), F.coalesce(F.max(F.col("relevant").cast("double")), F.lit(0.0)).alias("recall"))
    return per.withColumn("retrieval_match", F.round((F.col("precision") + F.col("recall")) / 2, 4))


def case_results(cases: DataFrame, present: DataFrame, found: DataFrame) -> DataFrame:
    """cases (case_id, expected), present (case_id, found: is the expected document there?) and found (case_id, rank, title): case_id,
    status (Skipped, Found, Not found), precision, recall, retrieval_match. A skipped case has no precision and recall, and a match of 0."""
    there = cases.join(present.select("case_id", F.col("found").alias("there")), "case_id")
    flags = found.join(there.where("there"), "case_id").select("case_id", "rank", S.names_match(F.col("title"), F.col("expected")).alias("relevant"))
    rows = there.join(context_metrics(flags), "case_id", "left")
    known = lambda c: F.when(F.col("there"), F.coalesce(c, F.lit(0.0)))
    return rows.select(
        "case_id", F.when(~F.col("there"), "Skipped").when(F.col("recall") > 0, "Found").otherwise("Not found").alias("status"),
        known("precision").alias("precision"), known("recall").alias("recall"), F.coalesce(known("retrieval_match"), F.lit(0.0)).alias("retrieval_match"),
    )


def faithfulness(claims: DataFrame) -> DataFrame:
    """claims (case_id, supported, total): supported within 0..total, as a share; 0 without claims."""
    inside = F.greatest(F.lit(0), F.least("supported", "total"))
    return claims.select("case_id", F.coalesce(F.round(F.try_divide(inside.cast("double"), F.col("total").cast("double")), 4), F.lit(0.0)).alias("faithfulness"))


def metric_means(cases: DataFrame, metrics: list[str]) -> DataFrame:
    """Means of each metric over cases that have it; a metric that none has is left out."""
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    long = cases.selectExpr(f"stack({len(metrics)}, {pairs}) as (metric, value)")
    means = long.groupBy("metric").agg(F.round(F.avg("value"), 4).alias("score"), F.count("value").alias("n"), F.count("*").alias("total")).where("n > 0")
    return means.select("metric", "score", F.format_string("%.1f%% su %d/%d casi", F.bround(F.col("score") * 100, 1), "n", "total").alias("delta"))


def latency_stats(samples: DataFrame, phase: str | None = None) -> DataFrame:
    """samples (phase, seconds): count, total, mean, min, max of each phase, unrounded. phase: that one alone, if it has samples, else all."""
    stats = samples.groupBy("phase").agg(F.count("*").alias("n"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))
    if phase is None:
        return stats
    there = stats.agg(F.coalesce(F.bool_or(F.col("phase") == phase), F.lit(False)).alias("_there"))  # one row
    return stats.join(F.broadcast(there)).where((F.col("phase") == phase) | ~F.col("_there")).drop("_there")


def latency_report(stats: DataFrame) -> DataFrame:
    """One text: a title and a line for each phase, in order of their names; the phases of a program are few."""
    seconds = lambda c: F.bround(c, 3)
    line = F.format_string("Fase: %-15s | Conteggio: %-3d | Media: %.3fs | Min: %.3fs | Max: %.3fs | Totale: %.3fs", "phase", "n", *map(seconds, ("mean", "least", "most", "total")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("phase", line.alias("line")))), lambda x: x["line"])
    return stats.agg(F.when(F.count("*") > 0, F.array_join(F.concat(F.array(F.lit("=== Report Latenza RAG ===")), lines), "\n")).otherwise("Nessuna misurazione registrata.").alias("report"))


#: The component of each phase, and that of any other.
COMPONENTS = {"embedding": "Ollama", "hybrid_search": "LanceDB", "rerank": "CrossEncoder", "generation": "Ollama"}
OTHER_COMPONENT = "FastAPI"


def telemetry_snapshot(stats: DataFrame, components: dict[str, str] = COMPONENTS) -> DataFrame:
    """id, level, component, message, duration_ms (the mean, cut off) from latency statistics; one row that says ready if there are none."""
    names = F.create_map(*[F.lit(x) for pair in components.items() for x in pair])
    shown = lambda id_, component, message, ms: [id_.alias("id"), F.lit("INFO").alias("level"), component.alias("component"), message.alias("message"), ms.cast("int").alias("duration_ms")]
    rows = stats.select(*shown(
        F.concat(F.lit("telemetry-"), "phase"), F.coalesce(F.try_element_at(names, F.col("phase")), F.lit(OTHER_COMPONENT)),
        F.concat(F.lit("Fase '"), "phase", F.lit("' completata ("), F.col("n").cast("string"), F.lit(" chiamate)")), F.col("mean") * 1000,
    ))
    idle = stats.agg(F.count("*").alias("k")).where("k = 0").select(*shown(F.lit("telemetry-system"), F.lit(OTHER_COMPONENT), F.lit("Sistema RAG pronto e in ascolto."), F.lit(0)))
    return rows.unionByName(idle)


def mean_duration(samples: DataFrame, value: str) -> DataFrame:
    """The mean over finite values of 0 and more; null without any."""
    v = F.col(value).cast("double")
    return samples.agg(F.avg(F.when((v >= 0) & ~F.isnan(v) & (v < float("inf")), v)).alias("mean"))


def job_summary(cases: DataFrame) -> DataFrame:
    """cases (case_id, status): one row with status, errors, error (null without) and found as x/total."""
    counted = cases.agg(F.count_if(F.col("status") == "Error").alias("errors"), F.count_if(F.col("status") == "Found").alias("hits"), F.count("*").alias("total"))
    failed = F.col("errors") > 0
    return counted.select(
        F.when(failed, "completed_with_errors").otherwise("completed").alias("status"), "errors",
        F.when(failed, F.concat(F.col("errors").cast("string"), F.lit(" casi non valutabili"))).alias("error"), F.concat_ws("/", "hits", "total").alias("found"),
    )


def _refined(values: DataFrame, state: DataFrame, group: str, value: str) -> DataFrame:
    """Narrower bounds of each group's place: two of the GRID quantiles of what lies within the bounds there are."""
    inside = join_in_parts(values, settled(state.select(group, "low", "high", "rows").withColumn("n", F.col("rows"))), group).where(F.col(value).between(F.col("low"), F.col("high")))
    grid = inside.groupBy(group).agg(F.percentile_approx(value, [k / GRID for k in range(GRID + 1)], 20 * GRID).alias("grid"))
    share = (F.col("place") - F.col("before")) / F.col("inside") * GRID
    edge = lambda k, none: F.when(k.between(0, GRID), F.try_element_at("grid", (k + 1).cast("int"))).otherwise(none)
    narrow = state.join(grid, group).select(group, "rows", "most", "place", "before", F.col("low").alias("floor"), edge(F.floor(share) - 1, F.col("low")).alias("low"), edge(F.ceil(share) + 2, F.col("high")).alias("high"))
    narrow = settled(narrow)
    counted = join_in_parts(values, settled(narrow.select(group, "floor", "low", "high", "rows").withColumn("n", F.col("rows"))), group).groupBy(group).agg(
        F.count_if(F.col(value).between(F.col("floor"), F.col("low")) & (F.col(value) < F.col("low"))).alias("skipped"), F.count_if(F.col(value).between(F.col("low"), F.col("high"))).alias("inside"))
    return settled(narrow.join(counted, group).select(group, "rows", "most", "place", (F.col("before") + F.col("skipped")).alias("before"), "inside", "low", "high"))


def p95(samples: DataFrame, group: str, value: str, zero_is_missing: bool = False, few: int = FEW) -> DataFrame:
    """The value at place floor(0.95 n), from 0, of each group's sorted values. zero_is_missing: where that is 0, the largest value.

    No group is sorted: bounds around the place are narrowed by quantiles, a hundredfold a round and over all groups at once, until at most
    `few` rows or a single value lie within them; then the place is counted out. Nulls are left out; no rows give no rows.
    """
    values = samples.where(F.col(value).isNotNull()).select(group, value)
    first = values.groupBy(group).agg(F.count("*").alias("rows"), F.min(value).alias("low"), F.max(value).alias("high"))
    state = first.select(group, "rows", F.col("high").alias("most"), F.floor(F.col("rows") * 0.95).alias("place"), F.lit(0).cast("long").alias("before"), F.col("rows").alias("inside"), "low", "high")
    state, wide = settled(state), (F.col("inside") > few) & (F.col("low") < F.col("high"))
    done = []
    for _ in range(ROUNDS):
        if not state.where(wide).limit(1).count():
            break
        done.append(state.where(~wide))
        state = _refined(values, state.where(wide), group, value)
    for part in done:
        state = state.unionByName(part)
    held = join_in_parts(values, settled(state.withColumn("n", F.col("rows"))), group).where(F.col(value).between(F.col("low"), F.col("high")))
    counts = held.groupBy(group, value, "place", "before", "rows", "most").agg(F.count("*").alias("k"))
    upto = F.col("before") + F.sum("k").over(W.Window.partitionBy(group).orderBy(value).rowsBetween(W.Window.unboundedPreceding, 0))
    found = counts.withColumn("upto", upto).where(F.col("upto") > F.col("place")).groupBy(group).agg(F.min(value).alias("p95"), F.max("rows").alias("n"), F.max("most").alias("most"))
    return found.select(group, F.when(F.lit(zero_is_missing) & (F.col("p95") == 0), F.col("most")).otherwise(F.col("p95")).alias("p95"), "n")


def request_rate(requests: DataFrame, client: str, ts: str, seconds: int = 60) -> DataFrame:
    """Requests of a client within the last seconds, at each request."""
    frame = f"count(*) over (partition by {client} order by {ts} range between interval {seconds} second preceding and current row)"
    return requests.withColumn("recent", F.expr(frame))
