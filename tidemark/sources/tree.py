"""Reading a working tree, an index and a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.identity import content_hash

#: Folders that are no part of a tree, at any depth. Fixed values.
EXCLUDED = [".git", ".agent", "target", "node_modules", "__pycache__", ".opencode"]

INDEX_SCHEMA = (
    "language string, relative_path string, symbols array<struct<symbol: string, relationships: array<struct<symbol: string, is_implementation: boolean, is_type_definition: boolean>>>>, "
    "occurrences array<struct<symbol: string, symbol_roles: int, range: array<int>>>"
)
LEDGER_SCHEMA = "ts_ms long, op string, key string, subject string, tag string, elapsed_us long"


def files(spark: SparkSession, root: str, excluded: list[str] | None = None, suffix: str | None = None, skip_hidden: bool = False) -> DataFrame:
    """``(path, content binary)`` of the files under ``root``, paths relative to it; Spark lists and reads them in parallel."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^\w+:(//)?", ""), "^" + base.replace(".", r"\.") + "/", "")
    parts = F.split("path", "/")
    out = found.select(path.alias("path"), "content").where(~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in (EXCLUDED if excluded is None else excluded)])))
    if suffix:
        out = out.where(F.col("path").endswith(suffix))
    if skip_hidden:
        out = out.where(~F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.startswith(".")))
    return out


def as_text(found: DataFrame) -> DataFrame:
    """``(path, content string)``; bytes that are no UTF-8 stop the query."""
    return found.select("path", F.validate_utf8(F.col("content").cast("string")).alias("content"))


def manifest_of(found: DataFrame) -> DataFrame:
    return found.select("path", content_hash("content").alias("digest"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A semantic index exported as JSON lines, one document a line; a damaged line stops the query."""
    return spark.read.schema(INDEX_SCHEMA).option("mode", "FAILFAST").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).json(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trial rows of a multi-line JSON file."""
    return spark.read.option("multiLine", "true").json(path)
