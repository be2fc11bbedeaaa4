"""Versions of a tree: manifests, deltas between them, and which recorded views a delta may touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identity import content_hash, identity, set_digest


def manifest(files: DataFrame) -> DataFrame:
    """``files(path, content)`` to ``(path, digest)``; contents stay where they are read."""
    return files.select("path", content_hash("content").alias("digest"))


def manifest_entries(entries: DataFrame) -> DataFrame:
    """Distinct entries; a path with two digests stops the query."""
    n = F.count_distinct("digest")
    return entries.groupBy("path").agg(F.min("digest").alias("digest"), n.alias("n")).select("path", F.when(F.col("n") == 1, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("two digests: "), F.col("path")))).alias("digest"))


def manifest_id(entries: DataFrame) -> DataFrame:
    return set_digest(entries, "path", "digest", tag="manifest.v1")


def environment(declared: DataFrame) -> DataFrame:
    """``declared(key, value)`` to ``(key, value_digest)``; values are dropped. Blank and repeated keys stop the query, and so does an empty declaration."""
    if declared.isEmpty():
        raise ValueError("an environment declares at least one input")
    checked = F.when((F.trim("key") != "") & (F.col("n") == 1), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("bad key: "), F.coalesce("key", F.lit("null")))))
    return declared.groupBy("key").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n")).select(checked.alias("key"), content_hash("value").alias("value_digest"))


def environment_id(fingerprint: DataFrame) -> DataFrame:
    return set_digest(fingerprint, "key", "value_digest", tag="environment.v1")


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, change)`` with change added, modified or removed; a rename is a removal and an addition."""
    joined = old.select("path", F.col("digest").alias("was")).join(new.select("path", F.col("digest").alias("now")), "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return joined.select("path", change.alias("change")).where("change IS NOT NULL")


def classify(changes: DataFrame) -> DataFrame:
    """One row: does the delta touch source code?"""
    source = F.coalesce(F.bool_or(F.col("path").endswith(".py")), F.lit(False))
    return changes.agg(F.when(source, "python_source").otherwise("non_python").alias("change_class"), F.count(F.lit(1)).alias("changes"))


def freeze_decision(changes: DataFrame, has_freeze: bool) -> DataFrame:
    """Reuse the earlier freeze only if there is one and no source changed."""
    return classify(changes).select(F.when((F.col("change_class") == "non_python") & F.lit(has_freeze), "reuse").otherwise("freeze").alias("decision"))


def candidates(changes: DataFrame, recorded: DataFrame) -> DataFrame:
    """The rows of ``recorded(projection_id, kind, subject, anchor, ...)`` that the delta may touch; never too few.

    A file view is touched by its own path; a definition, signature or imports view by its anchor, or by any file that
    comes or goes, which may bind its name anew; any other view by any change. The two facts about the whole delta are one row.
    """
    facts = changes.agg(F.coalesce(F.bool_or(F.col("change") != "modified"), F.lit(False)).alias("inventory"), (F.count(F.lit(1)) > 0).alias("any"))
    paths = changes.select(F.col("path").alias("at")).distinct()
    local = F.col("kind").isin("definition", "signature", "imports")
    watched = F.when(F.col("kind") == "file", F.col("subject")).when(local, F.col("anchor"))
    touched = recorded.withColumn("at", watched).join(paths.withColumn("hit", F.lit(True)), "at", "left").join(F.broadcast(facts))  # one row
    hit = F.coalesce("hit", F.lit(False))
    return touched.where(F.when(F.col("kind") == "file", hit).when(local, hit | F.col("inventory")).otherwise(F.col("any"))).select(*recorded.columns)


def forced(recorded: DataFrame, bindings: DataFrame, universe: Column | str, coverage: Column | str, indexer: Column | str) -> DataFrame:
    """Views whose binding to universe, coverage or indexer is another, or missing."""
    now = [F.lit(x) if isinstance(x, str) else x for x in (universe, coverage, indexer)]
    joined = recorded.join(bindings.select("projection_id", "universe_digest", "coverage_digest", "indexer"), "projection_id", "left")
    same = F.col("universe_digest").eqNullSafe(now[0]) & F.col("coverage_digest").eqNullSafe(now[1]) & F.col("indexer").eqNullSafe(now[2])
    return joined.where(~same).select(*recorded.columns)


def dependents(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Distinct artifacts that depend on ``changed(projection_id)``."""
    return edges.join(changed.select("projection_id"), "projection_id", "left_semi").select("artifact_id").distinct()


def freeze(manifest_row: DataFrame, environment_row: DataFrame, parent: str | None, git_commit: str | None, created_at: int) -> DataFrame:
    """The snapshot row of two one-row digests."""
    both = manifest_row.select(F.col("digest").alias("manifest_id")).join(F.broadcast(environment_row.select(F.col("digest").alias("environment_id"))))
    out = both.select("*", F.lit(parent).cast("string").alias("parent_id"), F.lit(git_commit).cast("string").alias("git_commit"), F.lit(created_at).cast("long").alias("created_at"))
    return out.select(identity("snapshot.v1", "manifest_id", "environment_id", "parent_id", "git_commit", "created_at").alias("snapshot_id"), "*")


def apply_operations(files: DataFrame, operations: DataFrame) -> DataFrame:
    """A tree ``(path, content)`` after ``operations(op, path, content)``: add_file, replace_file, delete_file.

    An operation that does not fit (adding what is there, replacing with the same, deleting what is not) stops the query, and so do two on one path.
    """
    was, ops = files.select("path", F.col("content").alias("was")), operations.select(F.col("path"), "op", F.col("content").alias("new"))
    ops = ops.groupBy("path").agg(F.min("op").alias("op"), F.min("new").alias("new"), F.count(F.lit(1)).alias("n"))
    joined = was.join(ops, "path", "full_outer")
    there = F.col("was").isNotNull()
    fits = F.when(F.col("op") == "add_file", ~there & F.col("new").isNotNull()).when(F.col("op") == "replace_file", there & ~F.col("new").eqNullSafe(F.col("was"))).when(F.col("op") == "delete_file", there)
    bad = F.raise_error(F.concat(F.lit("operation does not fit: "), F.col("op"), F.lit(" "), F.col("path")))
    content = F.when(F.col("op").isNull(), F.col("was")).when((F.col("n") > 1) | ~F.coalesce(fits, F.lit(False)), bad).when(F.col("op") != "delete_file", F.col("new"))
    return joined.select("path", content.alias("content")).where("content IS NOT NULL")


def tree_at(base: DataFrame, operations: DataFrame, parents: dict[str, str | None], mutation: str) -> DataFrame:
    """The tree after a mutation and all its ancestors. ``operations(mutation, op, path, content)``; ``parents`` is a short catalog."""
    chain: list[str] = []
    at: str | None = mutation
    while at is not None:
        if at in chain:
            raise ValueError(f"{at} is its own ancestor")
        chain.append(at)
        at = parents[at]
    for name in reversed(chain):
        base = apply_operations(base, operations.where(F.col("mutation") == name))
    return base
