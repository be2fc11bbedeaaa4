"""Append-only histories: sequence numbers, standing, strength, trust and the rule for automatic reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.enums import AUTHORITY, CHANNELS, LEVELS, REUSE, TRUST, lookup


def violations(new: DataFrame, history: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``(attestation_id, reason)`` of rows that must not be appended: duplicate id, unknown artifact, earlier than the latest."""
    last = history.groupBy("artifact_id").agg(F.max("created_at").alias("last_at"))
    again = new.groupBy("attestation_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("attestation_id")
    dup = new.join(history.select("attestation_id").union(again), "attestation_id", "left_semi").select("attestation_id", F.lit("duplicate id").alias("reason"))
    unknown = new.join(artifacts.select("artifact_id"), "artifact_id", "left_anti").select("attestation_id", F.lit("unknown artifact").alias("reason"))
    late = new.join(last, "artifact_id").where("created_at < last_at").select("attestation_id", F.lit("out of order").alias("reason"))
    return dup.union(unknown).union(late).distinct()


def sequence(new: DataFrame, history: DataFrame) -> DataFrame:
    """``new`` with ``seq``, which goes on from the artifact's last one in the order of time and id."""
    last = history.groupBy("artifact_id").agg(F.max("seq").alias("last_seq"))
    order = F.row_number().over(Window.partitionBy("artifact_id").orderBy("created_at", "attestation_id"))
    return new.join(last, "artifact_id", "left").withColumn("seq", F.coalesce("last_seq", F.lit(0)).cast("long") + order).drop("last_seq")


def admitted(new: DataFrame, history: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``new`` with its sequence numbers, to be put behind ``history``; any violation stops it before a row is added."""
    bad = violations(new, history, artifacts).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['attestation_id']}: {bad[0]['reason']}")
    return sequence(new, history)


def append(new: DataFrame, history: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The history with ``new`` behind it."""
    return history.unionByName(admitted(new, history, artifacts).select(*history.columns))


def latest_validity(history: DataFrame) -> DataFrame:
    return history.groupBy("artifact_id").agg(F.max_by("validity", "seq").alias("validity"))


def strongest(history: DataFrame) -> DataFrame:
    """The attestation of highest authority, then level, then time, then id."""
    rank = F.struct(lookup(F.col("authority"), AUTHORITY), lookup(F.col("level"), LEVELS), "created_at", "attestation_id")
    return history.groupBy("artifact_id").agg(F.max_by(F.struct("attestation_id", "validity", "authority", "level", "created_at"), rank).alias("s")).select("artifact_id", "s.*")


def capture_trust(channels: Column | str) -> Column:
    """The weakest trust of an array of channels; without channels unobserved, and so is a channel that is not known."""
    c = F.col(channels) if isinstance(channels, str) else channels
    rank = F.array_min(F.transform(c, lambda x: F.coalesce(lookup(x, {k: TRUST[v] for k, v in CHANNELS.items()}), F.lit(0))))
    return lookup(F.coalesce(rank, F.lit(0)), {v: k for k, v in TRUST.items()})


def auto_reuse(validity: Column | str, authority: Column | str, trust: Column | str) -> Column:
    v, a, t = (F.col(x) if isinstance(x, str) else x for x in (validity, authority, trust))
    return (v == "VALID") & (a == "authoritative") & (t != "unobserved")


def reuse_class(kind: Column | str) -> Column:
    return lookup(F.col(kind) if isinstance(kind, str) else kind, REUSE)


def current_bindings(bindings: DataFrame) -> DataFrame:
    """The latest binding of each view of an append-only table; two different ones at one snapshot stop the query."""
    fields = ["universe_digest", "coverage_digest", "indexer", "completeness"]
    at = bindings.groupBy("projection_id", "snapshot_id").agg(F.max("seq").alias("seq"), F.count_distinct(F.struct(*fields)).alias("n"), F.max_by(F.struct(*fields), "seq").alias("b"))
    checked = at.withColumn("b", F.when(F.col("n") == 1, F.col("b")).otherwise(F.raise_error(F.concat(F.lit("conflicting binding: "), F.col("projection_id")))))
    return checked.groupBy("projection_id").agg(F.max_by(F.struct("snapshot_id", "b"), "seq").alias("l")).select("projection_id", "l.snapshot_id", "l.b.*")
