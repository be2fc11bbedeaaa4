"""Relations between symbols from an index of definitions, occurrences and relationships, as an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identity import identity, module_of, set_digest

#: Descriptors of a symbol after its package: a path in backquotes or a name, and one of the suffixes that name things.
DESCRIPTOR = r"(`[^`]+`|[\w$+-]+)([/.#:!]|\(\+?\d*\)\.|\(\w+\))"


def dotted(symbol: Column | str) -> Column:
    """``scheme manager package version `a/b.py`/Class#method().`` to ``a.b.Class.method``; null for locals and what cannot be read.

    Namespace, type, term and method suffixes are taken; a path loses its ``.py``.
    """
    raw = F.col(symbol) if isinstance(symbol, str) else symbol
    rest = F.regexp_extract(raw, r"^\S+ \S+ \S+ \S+ (.+)$", 1)
    names = F.regexp_extract_all(rest, F.lit(DESCRIPTOR), F.lit(1))
    clean = F.transform(names, lambda n: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(n, "`", ""), r"(/__init__)?\.py$", ""), "/", "."), r"^\.|\.$", ""))
    whole = F.regexp_replace(rest, DESCRIPTOR, "")
    return F.when(~raw.startswith("local ") & (rest != "") & (whole == ""), F.array_join(F.filter(clean, lambda n: n != "__init__"), "."))


def inventory(external: DataFrame, own: DataFrame) -> DataFrame:
    """``(symbol, dotted)``; a symbol of a document overrides an external one."""
    ranked = external.select("symbol", "dotted", F.lit(0).alias("r")).unionByName(own.select("symbol", "dotted", F.lit(1).alias("r")))
    return ranked.groupBy("symbol").agg(F.max_by("dotted", F.struct("r", "dotted")).alias("dotted"))


def enclosing(occurrences: DataFrame, definitions: DataFrame) -> DataFrame:
    """Each of ``occurrences(occ_id, document, module, line)`` with the innermost of ``definitions(document, member, start_line, end_line, pos)`` around it.

    An equi-join on the document with a containment condition; the narrowest definition wins, of equal ones the first;
    without one the module is the member.
    """
    inside = (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line"))
    defs = definitions.withColumnRenamed("document", "of_document")
    joined = occurrences.select("occ_id", "document", "module", "line").join(defs, (F.col("document") == F.col("of_document")) & inside, "left")
    best = joined.groupBy("occ_id").agg(F.min(F.when(F.col("member").isNotNull(), F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "pos", "member"))).alias("best"), F.first("module").alias("module"))
    return best.select("occ_id", F.coalesce("best.member", "module").alias("member"))


def reference_edges(occurrences: DataFrame, definitions: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges (subject, member) of occurrences that are no definitions, without those of a subject in its own module."""
    uses = occurrences.where(F.col("roles").bitwiseAND(1) == 0).join(symbols, "symbol")
    member = enclosing(uses, definitions)
    own = F.regexp_replace("dotted", r"\.[^.]+$", "")
    return uses.join(member, "occ_id").where(own != F.col("module")).select(F.col("dotted").alias("subject"), "member").distinct()


def relationship_edges(relationships: DataFrame, symbols: DataFrame) -> DataFrame:
    """``relationships(symbol, target, is_implementation, is_type_definition)`` to edges of implementations and subclasses."""
    named = relationships.join(symbols.toDF("symbol", "member"), "symbol").join(symbols.toDF("target", "subject"), "target")
    kinds = F.array(F.when(F.col("is_implementation"), F.lit("implementations")), F.when(F.col("is_type_definition"), F.lit("subclasses")))
    return named.select(F.explode(F.array_compact(kinds)).alias("relation"), "subject", "member").distinct()


def ingest(index: DataFrame) -> dict[str, DataFrame]:
    """An index of one row a document ``(language, relative_path, symbols, occurrences)`` to ``edges``, ``symbols`` and ``report``."""
    python = index.where(F.lower("language") == "python").withColumn("module", module_of("relative_path"))
    entry = python.select("relative_path", "module", F.explode("symbols").alias("s"))
    own = entry.select(F.col("s.symbol").alias("symbol"), dotted("s.symbol").alias("dotted")).where("dotted IS NOT NULL")
    occ = python.select(F.col("relative_path").alias("document"), "module", F.posexplode("occurrences").alias("pos", "o"))
    occ = occ.select(F.concat_ws(":", "document", "pos").alias("occ_id"), "document", "module", "pos", F.col("o.symbol").alias("symbol"), F.col("o.symbol_roles").alias("roles"), F.col("o.range").alias("range"))
    occ = occ.withColumn("line", F.col("range")[0]).withColumn("end", F.when(F.size("range") == 4, F.try_element_at("range", F.lit(3))).otherwise(F.col("range")[0]))
    external = occ.select("symbol", dotted("symbol").alias("dotted")).where("dotted IS NOT NULL").distinct()
    symbols = inventory(external, own)
    defs = occ.where(F.col("roles").bitwiseAND(1) == 1).join(symbols, "symbol").select("document", F.col("dotted").alias("member"), F.col("line").alias("start_line"), F.col("end").alias("end_line"), "pos")
    uses = reference_edges(occ, defs, symbols)
    links = entry.select(F.col("s.symbol").alias("symbol"), F.explode("s.relationships").alias("r")).select("symbol", F.col("r.symbol").alias("target"), "r.is_implementation", "r.is_type_definition")
    edges = uses.select(F.lit("callers").alias("relation"), "subject", "member").unionByName(uses.select(F.lit("references").alias("relation"), "subject", "member")).unionByName(relationship_edges(links, symbols))
    is_python = F.lower("language") == "python"
    report = index.agg(
        F.count_if(is_python).alias("ingested"),
        F.count_if(~is_python).alias("non_python"),
        F.coalesce(F.sum(F.when(is_python, F.size(F.filter("occurrences", lambda o: o["symbol_roles"].bitwiseAND(1) == 0)))), F.lit(0)).alias("references_seen"),
        F.coalesce(F.sum(F.when(is_python, F.aggregate("symbols", F.lit(0), lambda n, s: n + F.size(s["relationships"])))), F.lit(0)).alias("relationships_seen"),
    )
    return {"edges": edges, "symbols": symbols, "report": report}


def coverage(universe: DataFrame, documents: DataFrame) -> DataFrame:
    """The certificate of an index over ``universe(path)``: what it lacks are failures."""
    lacking = universe.join(documents.select("path"), "path", "left_anti").agg(F.array_sort(F.collect_list("path")).alias("failures"))
    state = F.when(F.size("failures") == 0, "established").otherwise("failed")
    return lacking.select(F.lit("established").alias("universe_complete"), state.alias("all_units_participated"), state.alias("declaration_inventory_complete"), state.alias("resolved_reference_coverage"), state.alias("inheritance_relationships"), "failures")


def universe_digest(paths: DataFrame) -> DataFrame:
    return set_digest(paths, "path", tag="universe.v1")


def indexer_identity(adapter, tool, version) -> Column:
    return F.format_string("%s (%s %s)", adapter, tool, version)


def semantic_snapshot(edges: DataFrame, documents: DataFrame, indexer: str) -> DataFrame:
    """One row: the identity of an indexer's edges and documents."""
    e = set_digest(edges, "relation", "subject", "member", tag="edges.v1").select(F.col("digest").alias("edges"))
    d = set_digest(documents, "path", tag="documents.v1").select(F.col("digest").alias("documents"))
    return e.join(F.broadcast(d)).select(identity("semantic.v1", F.lit(indexer), "edges", "documents").alias("semantic_snapshot"))


def overlay(frozen: DataFrame, live: DataFrame, modules: DataFrame) -> DataFrame:
    """Frozen edges of members outside the changed ``modules(module)`` with the live ones: provisional edges.

    A member belongs to the longest changed module that is a prefix of it at a dot; prefixes are exploded, so this is an equi-join.
    """
    parts = F.split("member", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    keyed = frozen.select("subject", "member").distinct().withColumn("module", F.explode(prefixes))
    gone = keyed.join(modules.select("module").distinct(), "module", "left_semi").select("subject", "member").distinct()
    return frozen.select("subject", "member").join(gone, ["subject", "member"], "left_anti").unionByName(live.select("subject", "member")).distinct()


def completeness(kind: Column | str, certificate_prefix: str = "") -> Column:
    """complete or unknown. Only kinds that need a complete universe ask for the certificate's universe, units, references and no failures."""
    from tidemark.operators.projections import sensitive

    c = lambda name: F.col(certificate_prefix + name) == "established"
    whole = c("universe_complete") & c("all_units_participated") & c("resolved_reference_coverage") & (F.size(certificate_prefix + "failures") == 0)
    return F.when(~sensitive(kind) | whole, "complete").otherwise("unknown")


def complete_certificate(rows: DataFrame) -> DataFrame:
    names = ["universe_complete", "all_units_participated", "declaration_inventory_complete", "resolved_reference_coverage", "inheritance_relationships"]
    return rows.withColumns({n: F.lit("established") for n in names} | {"failures": F.array().cast("array<string>")})


def with_failed_units(certificate: DataFrame, failed: list[str]) -> DataFrame:
    """A certificate in which units failed: participation, inventory and references fail with them."""
    if not failed:
        return certificate
    names = ["all_units_participated", "declaration_inventory_complete", "resolved_reference_coverage"]
    return certificate.withColumns({n: F.lit("failed") for n in names} | {"failures": F.array_sort(F.array(*[F.lit(f) for f in failed]))})


def resolve_symbols(symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """Each ``symbol`` with the longest indexed module that is a proper prefix of it, and what is nested in it."""
    parts = F.split("symbol", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), ".").alias("module")))
    # A symbol without a dot has no prefix and keeps its row all the same, so what is found needs no join with the symbols again.
    exploded = symbols.select("symbol").distinct().select("symbol", F.explode_outer(F.when(F.size(parts) >= 2, prefixes)).alias("p")).select("symbol", "p.n", "p.module")
    known = modules.select("module").distinct().withColumn("known", F.lit(True))
    found = exploded.join(known, "module", "left").groupBy("symbol").agg(F.max(F.when(F.col("known"), F.struct("n", "module"))).alias("best")).select("symbol", "best.module")
    nested = F.substring(F.col("symbol"), F.length("module") + 2, F.length("symbol"))
    return found.select("symbol", "module", nested.alias("nesting"))


