"""Closed sets of the domain, with ranks where order counts. Fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: kind: (property, subject variant, default scope, needs a complete universe)
KINDS = {
    "file": ("content", "file", "file", False),
    "definition": ("definition", "symbol", "repository", False),
    "signature": ("signature", "symbol", "repository", False),
    "references": ("references", "symbol", "repository", True),
    "callers": ("callers", "symbol", "repository", True),
    "implementations": ("implementations", "symbol", "repository", True),
    "imports": ("imports", "module", "module", False),
    "subclasses": ("subclasses", "symbol", "repository", True),
    "repository_search": ("matches", "text", "repository", True),
    "config_value": ("value", "config_key", "repository", False),
    "tool_version": ("version", "tool", "repository", False),
}
SCOPES = {"file": 0, "module": 1, "package": 2, "repository": 3}
VALIDITY = ["VALID", "STALE", "UNKNOWN"]
AUTHORITY = {"provisional": 0, "authoritative": 1}
TRUST = {"unobserved": 0, "declared_only": 1, "partial": 2, "complete": 3}
LEVELS = {"unverified": 0, "evidence_backed": 1, "structural": 2, "test": 3, "static": 4, "deterministic": 5}
#: channel of a derivation: what it can attest to by itself
CHANNELS = {"query_engine": "complete", "fully_intercepted": "complete", "partially_captured": "partial", "declared": "declared_only", "unobserved": "unobserved"}
#: artifact kind: reuse class
REUSE = {
    "structural_set": "A",
    "observation": "A",
    "fact": "B",
    "derived_fact": "B",
    "summary": "C",
    "hypothesis": "D",
    "plan": "E",
    "execution_result": "F",
    "patch": "F",
}
COVERAGE_STATES = ["established", "failed", "unproven"]


def lookup(key: Column, table: dict) -> Column:
    """A small fixed table as an expression; null for what it does not hold."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), key)


def kinds(spark: SparkSession) -> DataFrame:
    """One row a projection kind."""
    return spark.createDataFrame([(k, p, v, s, SCOPES[s], c) for k, (p, v, s, c) in KINDS.items()], "kind string, property string, variant string, scope string, scope_ordinal int, completeness_sensitive boolean")
