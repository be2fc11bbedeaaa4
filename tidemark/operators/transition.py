"""From one version to the next: outcomes of re-evaluated views, contracts of results, attestations, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.identity import attestation_id, content_hash, packed, verifier_id

SET_EQUALITY, ABSENCE = "set-equality.v1", "absence-fact.v1"

#: contract: when it holds, over the touched views of an artifact (``equal``: all have their pinned digest; ``empty``: all are the empty set).
#: A further contract is a further entry.
CONTRACTS = {SET_EQUALITY: lambda: F.col("equal"), ABSENCE: lambda: F.col("empty")}


def outcomes(candidates: DataFrame, evaluated: DataFrame, prior: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """``(projection_id, outcome, value, digest, prior_digest, value_changed, claim_dirty, authoritative, completeness)`` of the candidates.

    ``evaluated(projection_id, value, authoritative)``; ``prior(projection_id, digest, seq)``, all earlier observations;
    ``verdicts(projection_id, completeness, bound)``, now and when last bound. A view changed if its digest differs from any
    earlier one or its completeness from the bound one (an unbound one is dirty). A null value is unobserved.
    """
    now = candidates.select("projection_id").distinct().join(evaluated, "projection_id", "left").withColumn("digest", content_hash("value"))
    old = prior.groupBy("projection_id").agg(F.max_by("digest", "seq").alias("prior_digest"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    joined = now.join(old, "projection_id", "left")
    if verdicts is not None:
        joined = joined.join(verdicts, "projection_id", "left")
        dirty = ~F.col("completeness").eqNullSafe(F.col("bound"))
    else:
        joined = joined.withColumn("completeness", F.lit("complete"))
        dirty = F.lit(False)
    differs = F.coalesce((F.col("low") != F.col("digest")) | (F.col("high") != F.col("digest")), F.lit(False))
    out = joined.withColumn("value_changed", differs).withColumn("claim_dirty", dirty)
    outcome = F.when(F.col("value").isNull(), "unobserved").when(F.col("value_changed") | F.col("claim_dirty"), "changed").otherwise("unchanged")
    return out.select("projection_id", outcome.alias("outcome"), "value", "digest", "prior_digest", "value_changed", "claim_dirty", "authoritative", "completeness")


def latest(attestations: DataFrame) -> DataFrame:
    """The latest attestation of every artifact, as its row."""
    return attestations.groupBy("artifact_id").agg(F.max_by(F.struct("*"), "seq").alias("a")).select("a.*")


def pins(attestations: DataFrame, observations: DataFrame) -> DataFrame:
    """``(artifact_id, projection_id, pinned)``: the digest of the last observation of a view in the latest attestation's evidence.

    ``attestations(artifact_id, seq, evidence array<observation id>)``, ``observations(observation_id, projection_id, digest)``;
    observation ids are texts, or on both sides the bytes that ``packed`` makes of them. Of a view that was observed once an
    artifact has one pin, when its evidence names no observation twice; only pins of the other views are grouped.
    """
    texts = dict(observations.dtypes)["observation_id"] == "string"
    own = packed("observation_id") if texts else F.col("observation_id")
    ids = F.transform("evidence", lambda x: packed(x)) if texts else F.col("evidence")
    last = F.reverse(F.array_distinct(F.reverse("evidence")))  # each observation where it comes last
    evidence = latest(attestations.select("artifact_id", "seq", ids.alias("evidence"))).select("artifact_id", F.posexplode(last).alias("pos", "of"))
    times = observations.groupBy("projection_id").agg(F.count(F.lit(1)).alias("times"))
    seen = observations.select(own.alias("of"), "projection_id", "digest").join(times, "projection_id")
    # Both read ``pos``, so that they share the shuffle of the evidence.
    once = evidence.join(seen.where("times = 1"), "of").select("artifact_id", "projection_id", F.when(F.col("pos") >= 0, F.col("digest")).alias("pinned"))
    often = evidence.join(seen.where("times > 1"), "of").groupBy("artifact_id", "projection_id").agg(F.max_by("digest", "pos").alias("pinned"))
    return once.unionByName(often)


def verdicts(changed: DataFrame, dependencies: DataFrame, pinned: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Contracts of the artifacts that depend on a changed view.

    ``changed(projection_id, digest, value, authoritative, completeness)``, ``dependencies(artifact_id, projection_id)``,
    ``artifacts(artifact_id, contract)``. Set equality holds if every touched view has its pinned digest, absence if every
    touched view is the empty set. Without a pin or a value nothing is decided; what holds with unknown completeness
    is not decided either, what fails stays failed.
    """
    # A pin meets its view first, so that of all digests and values only flags move on, under packed ids, and only for changed views.
    facts = changed.select(
        "projection_id", "digest", F.col("value").isNotNull().alias("observed"), F.coalesce(F.col("value") == "", F.lit(False)).alias("empty"),
        F.coalesce(F.col("completeness") == "unknown", F.lit(False)).alias("unproven"), F.coalesce("authoritative", F.lit(False)).alias("authoritative"),
    )
    at = packed("projection_id").alias("view")
    held = pinned.join(facts.select("projection_id", "digest"), "projection_id").select("artifact_id", at, F.col("pinned").isNotNull().alias("pinned"), F.coalesce(F.col("pinned") == F.col("digest"), F.lit(False)).alias("equal"))
    touched = facts.join(dependencies.where("artifact_id IS NOT NULL"), "projection_id").select("artifact_id", at, "observed", "empty", "unproven", "authoritative").join(held, ["artifact_id", "view"], "left")
    grouped = touched.groupBy("artifact_id").agg(
        F.bool_and(F.coalesce("pinned", F.lit(False)) & F.col("observed")).alias("decidable"),
        F.bool_and(F.coalesce("equal", F.lit(False))).alias("equal"),
        F.bool_and("empty").alias("empty"),
        F.bool_or("unproven").alias("unproven"),
        F.bool_and("authoritative").alias("authoritative"),
        F.count(F.lit(1)).alias("touched"),
    )
    joined = grouped.join(artifacts.select("artifact_id", "contract"), "artifact_id")
    holds = F.coalesce(*[F.when(F.col("contract") == name, condition()) for name, condition in CONTRACTS.items()])
    verdict = F.when(~F.col("decidable") | holds.isNull(), "undecidable").when(~holds, "fails").when(F.col("unproven"), "undecidable").otherwise("holds")
    return standing(joined.withColumn("verdict", verdict)).select("artifact_id", "contract", "verdict", "validity", "authority", "level", "verifier", "touched")


def standing(rows: DataFrame) -> DataFrame:
    """Validity, authority, level and verifier of ``(verdict, authoritative, contract)``."""
    decided = F.col("verdict") != "undecidable"
    return rows.withColumns(
        {
            "validity": F.when(F.col("verdict") == "holds", "VALID").when(F.col("verdict") == "fails", "STALE").otherwise("UNKNOWN"),
            "authority": F.when(decided & F.col("authoritative"), "authoritative").otherwise("provisional"),
            "level": F.when(decided, "structural").otherwise("unverified"),
            "verifier": F.when(decided, verifier_id("contract")),
        }
    )


def attest(verdicts_: DataFrame, evidence: DataFrame, snapshot: str, now: int, history: DataFrame) -> DataFrame:
    """Attestations to append, ``created_at`` = ``now`` plus their place in the order of artifacts; one already in the history is not repeated.

    ``evidence(artifact_id, evidence)`` holds the observations of touched views and, carried on, the last ones of the others.
    The place comes from counts of ranges of artifacts, so no task sorts them all. ``verdicts_`` are read twice, for the counts and for
    the rows: give them written, not to be computed again.
    """
    rows = verdicts_.join(evidence, "artifact_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    rows = rows.withColumn("bucket", F.substring(F.sha2("artifact_id", 256), 1, 3))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("artifact_id")) - 1
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # 4096 rows at most
    timed = rows.withColumn("within", within).join(F.broadcast(starts), "bucket").withColumn("created_at", F.lit(now) + F.col("start") + F.col("within"))
    named = timed.withColumn("attestation_id", attestation_id("artifact_id", F.lit(snapshot), "validity", "authority", "level", "verifier", F.array_join("evidence", ","), F.lit(now)))
    new = named.join(history.select("attestation_id"), "attestation_id", "left_anti")
    return new.select("attestation_id", "artifact_id", F.lit(snapshot).alias("snapshot_id"), "validity", "authority", "level", "verifier", "evidence", "created_at")


def explain(outcomes_: DataFrame, dependencies: DataFrame, views: DataFrame) -> DataFrame:
    """``(artifact_id, explanation)``: what became of each touched view, in the order of kind and subject."""
    named = outcomes_.join(views.select("projection_id", "kind", "subject"), "projection_id").join(dependencies, "projection_id")
    what = F.when(F.col("outcome") == "changed", F.concat(F.lit("changed to ["), F.coalesce("value", F.lit("")), F.lit("]"))).otherwise(F.col("outcome"))
    line = F.concat(F.lit("dependency "), "kind", F.lit("("), "subject", F.lit(") "), what)
    return named.groupBy("artifact_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "subject", line.alias("line")))), lambda s: s["line"]), "; ").alias("explanation"))


def anchor(kind: Column | str, subject: Column | str, module_path: Column | str) -> Column:
    """The path that a view is evaluated against: its file, else the file of its module, else none."""
    k, s, p = (F.col(x) if isinstance(x, str) else x for x in (kind, subject, module_path))
    return F.when(k == "file", s).when(k.isin("definition", "signature", "imports"), p)
