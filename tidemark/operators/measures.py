"""Measures of runs: confusion counts, exact percentiles, per-condition summaries, ledger counters, cache ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; nothing out of nothing is 1."""
    return F.when(b == 0, F.lit(1.0)).otherwise(a / b)


def confusion(labelled: DataFrame) -> DataFrame:
    """``labelled(expected, actual)``, validities, to one row of seven measures."""
    c = F.count_if
    e, a = F.col("expected"), F.col("actual")
    counts = labelled.agg(
        F.count(F.lit(1)).alias("rows"),
        c(e == a).alias("matches"),
        c((e != "VALID") & (a == "VALID")).alias("false_valid"),
        c(e != "VALID").alias("oracle_invalid"),
        c((e != "VALID") & (a != "VALID")).alias("right"),
        c(a != "VALID").alias("flagged"),
        c((e == "UNKNOWN") & (a == "UNKNOWN")).alias("abstention_matches"),
    )
    return counts.select("rows", "matches", "false_valid", "oracle_invalid", ratio(F.col("right"), F.col("oracle_invalid")).alias("stale_recall"), ratio(F.col("right"), F.col("flagged")).alias("invalidation_precision"), "abstention_matches")


def exact_percentile(rows: DataFrame, group: str, value: str, fractions: dict[str, float], nearest: bool = False) -> DataFrame:
    """Values at index floor((n - 1) p), or by nearest rank ceil(p n) - 1, of each group: no interpolation.

    Counts of distinct values are made before the shuffle and summed in order, so a group is never collected.
    """
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    summed = counts.withColumn("upto", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))

    def place(p: float) -> Column:
        return F.greatest(F.ceil(F.lit(p) * F.col("all")) - 1, F.lit(0)) if nearest else F.floor((F.col("all") - 1) * F.lit(p))

    return summed.groupBy(group).agg(F.max("all").alias("n"), *[F.min(F.when(F.col("upto") > place(p), F.col(value))).alias(name) for name, p in fractions.items()])


def probe_gate(probes: DataFrame, limit_s: float = 15.0) -> DataFrame:
    """``probes(model, ok, latency_s)``: a model passes with no failure and a nearest-rank p95 under the limit."""
    p95 = exact_percentile(probes.where("latency_s IS NOT NULL"), "model", "latency_s", {"p95": 0.95}, nearest=True).drop("n")
    failures = probes.groupBy("model").agg(F.count(F.lit(1)).alias("probes"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failures"))
    return failures.join(p95, "model", "left").withColumn("passed", (F.col("failures") == 0) & F.coalesce(F.col("p95") < limit_s, F.lit(False)))


def summarize(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Totals and means; a metric that no row has stays null."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), *[x for m in metrics for x in (F.sum(m).alias(f"{m}_total"), F.round(F.avg(m), 2).alias(f"{m}_mean"))])


def by_condition(rows: DataFrame, metric: str, by: str = "task") -> DataFrame:
    """Means of two conditions side by side."""
    return rows.groupBy(by).agg(*[F.avg(F.when(F.col("condition") == c, F.col(metric))).alias(f"{metric}_{c.lower()}") for c in ("A", "B")])


def paired_delta(rows: DataFrame, metric: str) -> DataFrame:
    """B minus A for each trial; a condition that a trial lacks counts 0."""
    sums = rows.groupBy("trial").agg(*[F.sum(F.when(F.col("condition") == c, F.col(metric))).alias(c) for c in ("A", "B")])
    return sums.select("trial", (F.coalesce("B", F.lit(0)) - F.coalesce("A", F.lit(0))).alias("delta"))


def discordance(rows: DataFrame) -> DataFrame:
    """``rows(trial, task, condition, success)`` to the four counts of pass and fail; a task that B lacks failed there."""
    pair = rows.groupBy("trial", "task").agg(*[F.max(F.when(F.col("condition") == c, F.col("success").cast("int"))).alias(c) for c in ("A", "B")]).where("A IS NOT NULL")
    a, b = F.col("A") == 1, F.coalesce(F.col("B"), F.lit(0)) == 1
    return pair.agg(F.count_if(a & b).alias("both_pass"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("both_fail"))


def decumulate(rows: DataFrame, metric: str) -> DataFrame:
    """Differences of a counter within (trial, condition), in the order of ``task_rank``; the first counts from 0."""
    w = Window.partitionBy("trial", "condition").orderBy("task_rank")
    return rows.withColumn(f"{metric}_own", F.col(metric) - F.lag(metric, 1, 0).over(w))


def tool_counters(lines: DataFrame) -> DataFrame:
    """Counters of ledger lines (JSON text ``line``); lines that cannot be read are skipped. Whatever is not reuse was served fresh."""
    e = lines.select(F.from_json("line", "ts_ms long, op string, key string, subject string, tag string, elapsed_us long").alias("e")).select("e.*").where("op = 'tool'")
    return e.agg(
        F.count_if(F.col("tag") == "reuse").alias("avoided"),
        F.count_if(~F.col("tag").eqNullSafe("reuse")).alias("served_fresh"),
        F.count_if(F.col("tag") == "fresh+captured").alias("captured"),
        F.coalesce(F.sum("elapsed_us"), F.lit(0)).cast("long").alias("elapsed_us"),
    )


def first_events(events: DataFrame, key: str) -> DataFrame:
    """The first line of each key wins; lines without a key are skipped."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*events.columns), "line_no").alias("e")).select("e.*")


def accrual(attempts: DataFrame, wanted: int = 5, most: int = 8) -> DataFrame:
    """Go on? ``attempts(n, valid)``: stop at enough valid pairs, after an invalid attempt, or at the most attempts, in this order."""
    s = attempts.agg(F.count_if("valid").alias("valid"), F.count(F.lit(1)).alias("attempts"), F.max_by("valid", "n").alias("last"))
    reason = F.when(F.col("valid") >= wanted, "enough valid pairs").when(~F.col("last"), "last attempt invalid").when(F.col("attempts") >= most, "attempts exhausted").otherwise("continue")
    return s.select((reason == "continue").alias("go_on"), reason.alias("reason"))


def pair_health(pre: Column, post: Column) -> Column:
    """Why a pair of runs does or does not count, from the gates before and after it."""
    return F.when(~F.coalesce(pre, F.lit(False)), "PROVIDER_HEALTH_FAILED_BEFORE_PAIR").when(~F.coalesce(post, F.lit(False)), "PROVIDER_HEALTH_FAILED_AFTER_PAIR").otherwise("valid")


def cost_ratio(recompute: Column, validate: Column) -> Column:
    return recompute / F.greatest(validate, F.lit(1))


def ladder(requests: DataFrame) -> DataFrame:
    """``requests(seq, subject, tree_digest, file_digest, scoped_digest)``: hits and recomputations of four cache keys.

    A request hits if an earlier one had the same key; fresh never does.
    """
    strategies = {"fresh": F.col("seq").cast("string"), "exact": F.concat_ws("|", "subject", "tree_digest"), "file": F.concat_ws("|", "subject", "file_digest"), "scoped": F.concat_ws("|", "subject", "scoped_digest")}
    keyed = requests.select(F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), k.alias("key")) for n, k in strategies.items()])).alias("k")).select("k.*")
    return keyed.groupBy("strategy", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("strategy").agg(F.sum("n").cast("long").alias("requests"), F.count(F.lit(1)).alias("recomputations"), F.sum(F.col("n") - 1).cast("long").alias("hits"))


def pair_metric_diffs(attempts: DataFrame, metric: str) -> DataFrame:
    """``attempts(pair, condition, valid, ...)``: of the valid pairs, number, median and mean of B minus A."""
    sums = attempts.where("valid").groupBy("pair").agg(*[F.sum(F.when(F.col("condition") == c, F.col(metric))).alias(c) for c in ("A", "B")])
    diff = (F.col("B") - F.col("A")).cast("double")
    return sums.where("A IS NOT NULL AND B IS NOT NULL").agg(F.count(F.lit(1)).alias("pairs"), F.median(diff).alias("median"), F.avg(diff).alias("mean"))


#: counter: tool names that it counts. Fixed values.
TOOLS = {"file_reads": ["Read"], "repo_searches": ["Grep", "Glob"], "shell_cmds": ["Bash"], "edits": ["Edit", "Write"], "tool_search_calls": ["ToolSearch"]}
TOKENS = ["input_tokens", "output_tokens", "cached_read_tokens", "cached_write_tokens"]


def event_counters(events: DataFrame, service: str = "mcp__service__") -> DataFrame:
    """Thirteen counters of ``events(line_no, message_id, tool_id, kind, name, *TOKENS)`` of a run: the first line of a message and of a tool call counts.

    ``kind`` is message or tool, ``name`` a tool's name; the service's own tools begin with ``service``, and all of them but its code_query are ceremony.
    """
    messages = first_events(events.where("kind = 'message'"), "message_id").agg(F.count(F.lit(1)).alias("model_calls"), *[F.coalesce(F.sum(t), F.lit(0)).cast("long").alias(t) for t in TOKENS])
    own, query = F.col("name").startswith(service), F.col("name") == f"{service}code_query"
    calls = first_events(events.where("kind = 'tool'"), "tool_id").agg(
        F.count(F.lit(1)).alias("tool_ops"),
        *[F.count_if(F.col("name").isin(names)).alias(counter) for counter, names in TOOLS.items()],
        F.count_if(query).alias("code_query_calls"),
        F.count_if(own & ~query).alias("ceremony_calls"),
    )
    return messages.join(F.broadcast(calls))  # one row each


#: field of a condition's summary: the counters it adds up. Fixed values.
FIELDS = {
    "success_count": ["success"], "timeout_count": ["timed_out"], "wall_time_s": ["wall_clock_s"], "model_calls": ["model_calls"], "input_tokens": ["input_tokens"],
    "output_tokens": ["output_tokens"], "provider_cached_tokens": ["cached_read_tokens", "cached_write_tokens"], "logical_tool_calls": ["code_query_calls"],
    "underlying_computations": ["served_fresh"], "avoided_computations": ["avoided"], "file_reads": ["file_reads"], "repository_searches": ["repo_searches"],
    "shell_operations": ["shell_cmds"], "automatic_captures": ["captured"], "valid_reuse": ["avoided"], "stale_withholding": None, "unknown_results": None,
    "false_valid_reuse": None, "runtime_time_s": ["validation_us"], "ceremony_calls": ["ceremony_calls"], "tool_search_calls": ["tool_search_calls"],
}


def condition_fields(rows: DataFrame, by: str = "condition") -> DataFrame:
    """The 21 fields of each condition's summary. A counter that rows lack counts 0; what is not observed on this path is null and never 0."""

    def total(names: list[str] | None) -> Column:
        if names is None:
            return F.lit(None).cast("long")
        parts = [F.coalesce(F.sum(F.col(n).cast("double" if n == "wall_clock_s" else "long")), F.lit(0)) for n in names if n in rows.columns]
        return sum(parts[1:], parts[0]) if parts else F.lit(0).cast("long")

    rounded = {"wall_time_s": lambda c: F.round(c.cast("double"), 1), "runtime_time_s": lambda c: F.round(c / 1e6, 3)}
    return rows.groupBy(by).agg(*[rounded.get(field, lambda c: c)(total(names)).alias(field) for field, names in FIELDS.items()])


def materialize(reuse_probability: Column, recompute: Column, *costs: Column) -> Column:
    """Store a result if what its reuse is expected to save is more than capturing, validating, storing and retrieving cost."""
    total = costs[0]
    for c in costs[1:]:
        total = total + c
    return reuse_probability * recompute > total
