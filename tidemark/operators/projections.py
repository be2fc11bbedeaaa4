"""The eleven views over a version, each evaluated for all its keys at once.

An evaluator takes the keys and gives ``(projection_id, value)``. A null value is *unobserved*; ``''`` is the proven empty
set and ``absent`` the proven absence; the three are never turned into one another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.enums import KINDS, SCOPES, lookup
from tidemark.functions.identity import US, content_hash, projection_id, set_value
from tidemark.operators.semantic import resolve_symbols

RELATIONS = ("references", "callers", "implementations", "subclasses")


def key_of(subject: str, kind: str):
    """The ``projection_id`` of the view of a kind and subject, in the kind's default scope."""
    prop, variant, scope, _ = KINDS[kind]
    return projection_id(F.lit(kind), F.lit(variant), subject, F.lit(prop), F.lit(SCOPES[scope]))


def keys(subjects: DataFrame, kind: str) -> DataFrame:
    """``subjects(subject)`` as rows ``(projection_id, kind, subject, scope)`` in the kind's default scope; blank subjects stop the query."""
    prop, variant, scope, _ = KINDS[kind]
    subject = F.when(F.trim("subject") != "", F.col("subject")).otherwise(F.raise_error(F.lit("blank subject")))
    rows = subjects.select(subject.alias("subject")).withColumn("kind", F.lit(kind)).withColumn("scope", F.lit(scope))
    return rows.select(projection_id("kind", F.lit(variant), "subject", F.lit(prop), F.lit(SCOPES[scope])).alias("projection_id"), "kind", "subject", "scope")


def parse_key(rows: DataFrame, text: str = "key") -> DataFrame:
    """``Kind(subject, Scope)`` to kind, subject and scope; a missing scope is file, and unreadable text gives nulls."""
    pattern = r"^\s*([A-Za-z_]+)\((.*?)(?:,\s*(File|Module|Package|Repository))?\)\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    fits = F.col(text).rlike(pattern)
    kind = F.lower(F.regexp_replace(part(1), "(?<=[a-z])(?=[A-Z])", "_"))
    scope = F.when(part(3) == "", "file").otherwise(F.lower(part(3)))
    return rows.select(text, F.when(fits, kind).alias("kind"), F.when(fits, F.trim(part(2))).alias("subject"), F.when(fits, scope).alias("scope"))


def file(keys_: DataFrame, manifest: DataFrame) -> DataFrame:
    """The digest at a path; a path the tree does not hold is absent, and only source files are observed."""
    joined = keys_.join(manifest.withColumnRenamed("path", "subject"), "subject", "left")
    return joined.select("projection_id", F.when(F.col("subject").endswith(".py"), F.coalesce("digest", F.lit("absent"))).alias("value"))


LOCAL = ("definition", "signature", "imports")


def anchored(keys_: DataFrame, units: DataFrame) -> DataFrame:
    """``keys_`` with ``anchor``, the path that each view is evaluated against, and ``parsed``, whether its unit can be read.

    ``units(module, path, status)``. A symbol belongs to the longest indexed module that is a proper prefix of it. A view of a
    module or symbol without a unit has neither; a file is its own anchor, and all other views have none.
    """
    modules = units.select("module", F.col("path").alias("unit_path"), (F.col("status") == "parsed").alias("unit_parsed"))
    symbols = resolve_symbols(keys_.where(F.col("kind").isin("definition", "signature")).select(F.col("subject").alias("symbol")), units)
    names = symbols.select(F.col("symbol").alias("subject"), F.lit(True).alias("of_symbol"), "module")
    named = keys_.withColumn("of_symbol", F.col("kind").isin("definition", "signature")).join(names, ["subject", "of_symbol"], "left")
    named = named.withColumn("module", F.when(F.col("kind") == "imports", F.col("subject")).otherwise(F.col("module"))).join(modules, "module", "left")
    anchor = F.when(F.col("kind") == "file", F.col("subject")).when(F.col("kind").isin(*LOCAL), F.col("unit_path"))
    return named.select(*keys_.columns, anchor.alias("anchor"), F.coalesce("unit_parsed", F.lit(False)).alias("parsed"))


def local(keys_: DataFrame, definitions: DataFrame | None = None, imports_: DataFrame | None = None, units: DataFrame | None = None) -> DataFrame:
    """``keys_`` of the ``LOCAL`` kinds with their ``value``, and ``anchor`` where ``units`` or an ``anchored`` frame says it; keys of other kinds are left out.

    All kinds go through one join with what the facts say, and their units are looked up once, not once a kind. A kind without facts is unobserved.
    """
    asked = [k for k, there in zip(LOCAL, (definitions, definitions, imports_), strict=True) if there is not None]
    keyed = keys_.where(F.col("kind").isin(*LOCAL))
    if "parsed" not in keyed.columns:
        keyed = keyed.withColumn("parsed", F.lit(True)) if units is None else anchored(keyed, units)
    facts = []
    if definitions is not None:
        at, symbol = F.struct("start_line", "start_column"), F.col("symbol").alias("subject")
        both = definitions.groupBy(symbol).agg(F.min_by(F.concat_ws("@", "kind", "symbol"), at).alias("d"), F.min_by("signature", F.when(F.col("signature").isNotNull(), at)).alias("s"))
        rows = F.array(F.struct(F.lit("definition").alias("kind"), F.col("d").alias("found")), F.struct(F.lit("signature").alias("kind"), F.col("s").alias("found")))
        facts.append(both.select("subject", F.explode(rows).alias("f")).select("f.kind", "subject", "f.found"))
    if imports_ is not None:
        line = F.concat("target", F.lit(" as "), "binding", F.lit(" ("), F.col("from_import").cast("string"), F.lit(")"))
        facts.append(imports_.groupBy(F.col("module").alias("subject")).agg(set_value(line).alias("found")).select(F.lit("imports").alias("kind"), "subject", "found"))
    if not facts:
        return keyed.withColumn("value", F.lit(None).cast("string"))
    nothing = F.when(F.col("kind") == "imports", "").otherwise("absent")
    value = F.when(F.col("parsed") & F.col("kind").isin(*asked), F.coalesce("found", nothing))
    return keyed.join(reduce(DataFrame.unionByName, facts), ["kind", "subject"], "left").withColumn("value", value).drop("found")


def definition(keys_: DataFrame, definitions: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """``kind@symbol`` of the first definition of a symbol. With ``units``, a symbol of a unit that is not there or does not parse is unobserved."""
    return local(keys_, definitions, units=units).select("projection_id", "value")


def signature(keys_: DataFrame, definitions: DataFrame, units: DataFrame | None = None) -> DataFrame:
    return local(keys_, definitions, units=units).select("projection_id", "value")


def relation(keys_: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """The set of members of a relation; no edge means the empty set.

    Edges are aggregated before the join, with a partial pass before the shuffle, so a hot subject is no hot key.
    """
    sets = edges.where(F.col("relation") == name).groupBy("subject").agg(set_value("member").alias("found"))
    return keys_.join(sets, "subject", "left").select("projection_id", F.coalesce("found", F.lit("")).alias("value"))


def relation_digest(keys_: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``(projection_id, members, digest)``: the size and the digest of a relation's set, for sets too large to be one value.

    Members fall into 4096 buckets by their hash; a task holds one bucket of one subject, and a subject's digest is that of
    its ordered bucket digests. Equal sets have equal digests, so the cutoff at unchanged values works on them as well.
    """
    own = edges.where(F.col("relation") == name).select("subject", F.sha2(F.col("member").cast("binary"), 256).alias("leaf")).distinct()
    buckets = own.groupBy("subject", F.substring("leaf", 1, 3).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("leaf")), US), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda b: b["d"]), US)
    found = buckets.groupBy("subject").agg(F.sum("n").alias("members"), content_hash(F.concat_ws(US, F.lit("members.v1"), joined)).alias("digest"))
    empty = content_hash(F.concat_ws(US, F.lit("members.v1"), F.lit("")))
    return keys_.join(found, "subject", "left").select("projection_id", F.coalesce("members", F.lit(0)).cast("long").alias("members"), F.coalesce("digest", empty).alias("digest"))


def imports(keys_: DataFrame, imports_: DataFrame, units: DataFrame | None = None) -> DataFrame:
    return local(keys_, imports_=imports_, units=units).select("projection_id", "value")


def unsupported(keys_: DataFrame, served: list[str]) -> DataFrame:
    """``(projection_id, reason)`` of the views of kinds that no source serves: they are never answered by an empty set."""
    return keys_.where(~F.col("kind").isin(served)).select("projection_id", F.concat(F.lit("no source serves "), "kind").alias("reason"))


def repository_search(patterns: list[str], files: DataFrame) -> DataFrame:
    """``(subject, value)``: the paths whose content holds each text. Every file is read once for all patterns."""
    hits = F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains("content", p))
    found = files.select("path", F.explode(hits).alias("subject")).groupBy("subject").agg(set_value("path").alias("found"))
    every = files.sparkSession.createDataFrame([(p,) for p in patterns], "subject string")
    return every.join(found, "subject", "left").select("subject", F.coalesce("found", F.lit("")).alias("value"))


def environment_value(keys_: DataFrame, fingerprint: DataFrame) -> DataFrame:
    """Config values and tool versions: the digest of a declared input, or absent."""
    joined = keys_.join(fingerprint.withColumnRenamed("key", "subject"), "subject", "left")
    return joined.select("projection_id", F.coalesce("value_digest", F.lit("absent")).alias("value"))


def sensitive(kind) -> F.Column:
    """Does an answer need a complete universe?"""
    return lookup(F.col(kind) if isinstance(kind, str) else kind, {k: v[3] for k, v in KINDS.items()})


def evaluate(keys_: DataFrame, manifest=None, definitions=None, edges=None, imports_=None, fingerprint=None, files=None, patterns=(), units=None) -> DataFrame:
    """All kinds of which the source is there; for the others the value is null, which is unobserved."""

    def of(kind):
        return keys_.where(F.col("kind") == kind)

    parts, served = [], []

    def serve(kind, rows):
        served.append(kind)
        parts.append(rows.select("projection_id", "value"))

    if manifest is not None:
        serve("file", file(of("file"), manifest))
    if definitions is not None or imports_ is not None:
        kinds = [k for k, there in zip(LOCAL, (definitions, definitions, imports_), strict=True) if there is not None]
        served += kinds
        parts.append(local(keys_.where(F.col("kind").isin(*kinds)), definitions, imports_, units).select("projection_id", "value"))
    if edges is not None:
        for name in RELATIONS:
            serve(name, relation(of(name), edges, name))
    if fingerprint is not None:
        for kind in ("config_value", "tool_version"):
            serve(kind, environment_value(of(kind), fingerprint))
    if files is not None and patterns:
        serve("repository_search", of("repository_search").join(repository_search(list(patterns), files), "subject").select("projection_id", "value"))
    rest = keys_.where(~F.col("kind").isin(served)) if served else keys_
    return reduce(DataFrame.unionByName, parts, rest.select("projection_id", F.lit(None).cast("string").alias("value")))
