"""The store: append-only Parquet tables in one folder, with idempotent inserts and checks that fail closed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.identity import content_hash

VERSION = 1

SCHEMAS = {
    "blobs": "blob_id string, content binary",
    "snapshots": "snapshot_id string, repository_id string, git_commit string, manifest_id string, semantic_snapshot string, environment_id string, parent_id string, created_at long",
    "derivations": "derivation_id string, capture_trust string, channels array<string>, producer struct<harness: string, version: string, model: string>, created_at long",
    "artifacts": "artifact_id string, kind string, contract string, payload_ref string, proposition string, derivation_id string, created_snapshot string, schema_version int, created_at long, cost struct<capture_ms: long, validation_ms: long, recompute_ms: long, tokens: long>",
    "artifact_dependencies": "artifact_id string, projection_id string, position int",
    "attestations": "attestation_id string, artifact_id string, snapshot_id string, validity string, authority string, level string, verifier string, evidence array<string>, created_at long, seq long",
    "observations": "observation_id string, projection_id string, kind string, subject string, scope string, snapshot_id string, value_digest string, canonical_value string, anchor string, seq long",
    "symbol_locations": "symbol string, module string, source_path string",
    "bindings": "projection_id string, snapshot_id string, universe_digest string, coverage_digest string, indexer string, completeness string, seq long",
    "registry": "key string, artifact_id string, kind string, created_at long",
    "manifests": "manifest_id string, path string, digest string",
    "facts": "digest string, fact string, module string, path string, symbol string, kind string, signature string, is_async boolean, target string, binding string, from_import boolean, start_line int, start_column int, end_line int, end_column int",
    "ledger": "ts_ms long, op string, key string, subject string, tag string, elapsed_us long",
}
KEYS = {"blobs": ["blob_id"], "snapshots": ["snapshot_id"], "derivations": ["derivation_id"], "artifacts": ["artifact_id"], "observations": ["observation_id"], "attestations": ["attestation_id"], "symbol_locations": ["symbol", "module", "source_path"], "artifact_dependencies": ["artifact_id", "projection_id"]}


class Store:
    """``read(table)`` and ``put(table, rows)``. One wide row an observation makes a record atomic: id, view, value and anchor come together."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        meta = f"{self.folder}/_meta"
        if self.exists("_meta"):
            found = spark.read.schema("version int").json(meta).first()
        else:
            spark.createDataFrame([(VERSION,)], "version int").coalesce(1).write.json(meta)
            found = (VERSION,)
        if not found or found[0] != VERSION:
            raise ValueError(f"store version {found and found[0]}, this is {VERSION}")

    def exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def read(self, table: str) -> DataFrame:
        """A table; one that was never written is empty, and one that cannot be read stops the query."""
        if self.exists(table):
            return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.folder}/{table}")
        return self.spark.createDataFrame([], SCHEMAS[table])

    def scan(self, table: str, *order: str) -> DataFrame:
        """A whole table in the order of ``order``, by default its key: ranges of it are sorted side by side."""
        return self.read(table).orderBy(*(order or KEYS[table]))

    def contains(self, ids: DataFrame) -> DataFrame:
        """``ids(blob_id)`` with ``there``."""
        known = self.read("blobs").select("blob_id", F.lit(True).alias("there"))
        return ids.join(known, "blob_id", "left").withColumn("there", F.coalesce("there", F.lit(False)))

    def put(self, table: str, rows: DataFrame) -> None:
        """Append the rows whose key the table does not hold yet; tables without a key take all. Staged first, so the rows are read before the table grows."""
        schema = self.spark.createDataFrame([], SCHEMAS[table]).schema
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        if keys := KEYS.get(table):
            rows = rows.dropDuplicates(keys).join(self.read(table).select(*keys), keys, "left_anti").select(*[f.name for f in schema])
        stage = f"{self.folder}/_staging/{table}-{uuid.uuid4().hex}"
        rows.write.parquet(stage)
        self.spark.read.schema(schema).parquet(stage).write.mode("append").parquet(f"{self.folder}/{table}")

    def put_blobs(self, contents: DataFrame) -> None:
        self.put("blobs", contents.select(content_hash("content").alias("blob_id"), F.col("content").cast("binary")))

    def get_blobs(self, ids: DataFrame) -> DataFrame:
        """Blobs by ``ids(blob_id)``; content that does not have its hash stops the query."""
        return verified(self.read("blobs").join(ids, "blob_id", "left_semi"))

    def artifact(self, artifact_id: str) -> DataFrame:
        return self.read("artifacts").where(F.col("artifact_id") == artifact_id).join(self.read("derivations").withColumnRenamed("created_at", "derived_at"), "derivation_id", "left")

    def recorded(self) -> DataFrame:
        """All observations, each checked against its own identity; a damaged row stops the query."""
        from tidemark.functions.identity import observation_id

        good = F.col("observation_id") == observation_id("projection_id", "value_digest", "snapshot_id")
        complete = good & F.col("kind").isNotNull() & F.col("subject").isNotNull()
        return self.read("observations").withColumn("observation_id", F.when(complete, F.col("observation_id")).otherwise(F.raise_error(F.concat(F.lit("damaged observation "), F.coalesce("observation_id", F.lit("null"))))))


def verified(blobs: DataFrame) -> DataFrame:
    bad = F.raise_error(F.concat(F.lit("damaged blob "), "blob_id"))
    return blobs.select(F.when(F.col("blob_id") == content_hash("content"), F.col("blob_id")).otherwise(bad).alias("blob_id"), "content")


def orphans(blobs: DataFrame, referenced: DataFrame) -> DataFrame:
    """Blobs that nothing refers to; a report, nothing is deleted."""
    return blobs.select("blob_id").join(referenced.select("blob_id"), "blob_id", "left_anti")


def missing(referenced: DataFrame, blobs: DataFrame) -> DataFrame:
    return referenced.select("blob_id").distinct().join(blobs.select("blob_id"), "blob_id", "left_anti")


def collectable(blobs: DataFrame, artifacts: DataFrame, registry: DataFrame) -> DataFrame:
    """Mark and sweep: blobs that no artifact under a current key refers to. A report; nothing is deleted."""
    current = registry.groupBy("key").agg(F.max_by("artifact_id", "created_at").alias("artifact_id")).select("artifact_id").distinct()
    live = artifacts.join(current, "artifact_id", "left_semi").select(F.col("payload_ref").alias("blob_id"))
    return orphans(blobs, live)
