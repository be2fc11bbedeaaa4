"""Facts of Python source text: definitions, signatures, imports, parse status, approximate calls.

Parsing is the one thing Spark cannot express, so each batch of files goes through the standard library's parser and gives
flat rows; everything after that is joins. A file that does not parse gives one ``failed`` row and no facts: unsupported,
which is not empty.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identity import module_of, set_digest

FIELDS = "fact string, module string, path string, symbol string, kind string, signature string, is_async boolean, target string, binding string, from_import boolean, start_line int, start_column int, end_line int, end_column int"
_names = [f.split()[0] for f in FIELDS.split(", ")]
_types = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
_schema = pa.schema([(f.split()[0], _types[f.split()[1]]) for f in FIELDS.split(", ")])


def _text(node: ast.AST | None, source: str) -> str | None:
    return None if node is None else " ".join((ast.get_source_segment(source, node) or ast.unparse(node)).split())


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef, source: str) -> str:
    """Parameters with annotations and defaults as written, white space collapsed, and the return annotation."""
    a, out = node.args, []
    positional = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(positional) - len(a.defaults)) + list(a.defaults)

    def one(arg, default, prefix=""):
        note, value = _text(arg.annotation, source), _text(default, source)
        text = prefix + arg.arg + (f": {note}" if note is not None else "")
        return text if value is None else text + (" = " if note is not None else "=") + value

    for i, (arg, default) in enumerate(zip(positional, defaults, strict=True)):
        out.append(one(arg, default))
        if i + 1 == len(a.posonlyargs):
            out.append("/")
    if a.vararg:
        out.append(one(a.vararg, None, "*"))
    elif a.kwonlyargs:
        out.append("*")
    out += [one(arg, default) for arg, default in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    if a.kwarg:
        out.append(one(a.kwarg, None, "**"))
    returns = _text(node.returns, source)
    return f"({', '.join(out)})" + (f" -> {returns}" if returns is not None else "")


def facts_of(module: str, path: str, source: str) -> Iterator[dict]:
    base = {"module": module, "path": path}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        line = getattr(e, "lineno", None) or 1
        yield base | {"fact": "unit", "kind": "failed", "start_line": line, "start_column": 0, "end_line": line, "end_column": 0}
        return
    yield base | {"fact": "unit", "kind": "parsed"}
    waiting = [(child, module, "module") for child in tree.body[::-1]]
    while waiting:
        node, owner, inside = waiting.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            symbol, is_class, is_async = f"{owner}.{node.name}", isinstance(node, ast.ClassDef), isinstance(node, ast.AsyncFunctionDef)
            kind = "class" if is_class else ("async_" if is_async else "") + ("method" if inside == "class" else "function")
            span = {"start_line": node.lineno - 1, "start_column": node.col_offset, "end_line": (node.end_lineno or node.lineno) - 1, "end_column": node.end_col_offset}
            yield base | {"fact": "definition", "symbol": symbol, "kind": kind, "signature": None if is_class else signature(node, source), "is_async": None if is_class else is_async} | span
            waiting += [(child, symbol, "class" if is_class else "function") for child in node.body[::-1]]
            continue
        if isinstance(node, ast.Import):
            for name in node.names:
                yield base | {"fact": "import", "target": name.name, "binding": name.asname or name.name, "from_import": False, "start_line": node.lineno}
        elif isinstance(node, ast.ImportFrom):
            start = "." * node.level + (node.module or "")
            for name in node.names:
                yield base | {"fact": "import", "target": start + ("" if start.endswith(".") else ".") + name.name, "binding": name.asname or name.name, "from_import": True, "start_line": node.lineno}
        waiting += [(child, owner, inside) for child in list(ast.iter_child_nodes(node))[::-1]]


def winners(files: DataFrame) -> DataFrame:
    """``files(path, ...)`` with their ``module``; of two files of one module the package's ``__init__`` wins."""
    units = files.withColumn("module", module_of("path")).where("module IS NOT NULL")
    # Ties are settled on paths, of which a module has two at most; the few that lose go by a join that leaves the contents where they are read.
    wins = units.groupBy("module").agg(F.min("path").alias("low"), F.max("path").alias("high"), F.max(F.when(F.col("path").endswith("__init__.py"), F.col("path"))).alias("package"))
    losers = wins.where("low <> high").select(F.when(F.coalesce("package", "high") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("path"))
    return units.join(losers, "path", "left_anti")


def parse(units: DataFrame) -> DataFrame:
    """``units(path, content, module)`` to facts, one parse a unit."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content, module in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [{n: r.get(n) for n in _names} for r in facts_of(module, path, content or "")]
            yield pa.RecordBatch.from_pylist(rows, schema=_schema)

    return units.select("path", F.col("content").cast("string").alias("content"), "module").mapInArrow(each, FIELDS)


def index(files: DataFrame) -> DataFrame:
    """``files(path, content)`` to facts; of two files of one module the package's ``__init__`` wins."""
    return parse(winners(files.select("path", "content")))


def unseen(files: DataFrame, known: DataFrame) -> DataFrame:
    """``files(path, content, digest)`` that the facts ``known(path, digest, ...)`` do not cover: all that has to be parsed."""
    units = files.select("path", "content", "digest").withColumn("module", module_of("path")).where("module IS NOT NULL")
    return units.join(known.where("fact = 'unit'").select("path", "digest"), ["path", "digest"], "left_anti")


def parse_unseen(files: DataFrame, known: DataFrame) -> DataFrame:
    """Facts with ``digest`` of what ``known`` lacks, to be added to it."""
    new = unseen(files, known)
    return parse(new).join(new.select("path", "digest"), "path")


def known_facts(files: DataFrame, known: DataFrame) -> DataFrame:
    """The facts of ``files(path, digest)`` out of ``known``, which covers them: equal to ``index`` of the same files."""
    return known.join(winners(files.select("path", "digest")).select("path", "digest"), ["path", "digest"], "left_semi").select(*_names)


def definitions(facts: DataFrame) -> DataFrame:
    return facts.where("fact = 'definition'").select("symbol", "kind", "signature", "is_async", "module", "path", "start_line", "start_column", "end_line", "end_column")


def imports(facts: DataFrame) -> DataFrame:
    return facts.where("fact = 'import'").select("module", "target", "binding", "from_import", F.col("start_line").alias("line"))


def units(facts: DataFrame) -> DataFrame:
    return facts.where("fact = 'unit'").select("module", "path", F.col("kind").alias("status"), "start_line")


def changed_symbols(changes: DataFrame, units_: DataFrame, definitions_: DataFrame) -> DataFrame:
    """Symbols of changed files; if any of these files failed to parse, one row says that the answer is unsupported."""
    touched = units_.join(changes.select("path").distinct(), "path", "left_semi")
    failed = touched.agg(F.coalesce(F.bool_or(F.col("status") == "failed"), F.lit(False)).alias("failed"))
    found = definitions_.join(changes.select("path").distinct(), "path", "left_semi").select("symbol").distinct().join(F.broadcast(failed)).where("NOT failed")
    return found.select("symbol", F.lit(True).alias("proven")).union(failed.where("failed").select(F.lit(None).cast("string"), F.lit(False)))


def certificate(universe: DataFrame, units_: DataFrame) -> DataFrame:
    """Coverage of syntax alone: references are never resolved by it."""
    joined = universe.join(units_, "path", "left").agg(F.array_sort(F.collect_list(F.when(F.col("status").isNull() | (F.col("status") == "failed"), F.col("path")))).alias("failures"))
    bad = F.size("failures") > 0
    state = F.when(bad, "failed").otherwise("established")
    return joined.select(F.lit("established").alias("universe_complete"), state.alias("all_units_participated"), state.alias("declaration_inventory_complete"), F.when(bad, "failed").otherwise("unproven").alias("resolved_reference_coverage"), F.lit("unproven").alias("inheritance_relationships"), "failures")


def lacking(universe: DataFrame, units_: DataFrame) -> DataFrame:
    """The paths of ``universe(path)`` that have no unit or one that does not parse, a row each."""
    read = units_.where("status = 'parsed'").select("path")
    return universe.select("path").distinct().join(read, "path", "left_anti")


def unit_coverage(universe: DataFrame, units_: DataFrame, references: str = "unproven") -> DataFrame:
    """The certificate in one row of a fixed size: five states, the number of failures and their set's digest.

    ``references`` is what holds for resolved references where every unit took part; no source of syntax alone establishes them.
    """
    bad = lacking(universe, units_)
    one = set_digest(bad, "path", tag="failures.v1").select(F.col("entries").alias("failed"), F.col("digest").alias("failures_digest"))
    state = F.when(F.col("failed") > 0, "failed").otherwise("established")
    refs = F.when(F.col("failed") > 0, "failed").otherwise(references)
    return one.select(F.lit("established").alias("universe_complete"), state.alias("all_units_participated"), state.alias("declaration_inventory_complete"), refs.alias("resolved_reference_coverage"), F.lit("unproven").alias("inheritance_relationships"), "failed", "failures_digest")


def unit_inventory(definitions_: DataFrame) -> DataFrame:
    """Locations of symbols, to be recorded."""
    return definitions_.select("symbol", "module", F.col("path").alias("source_path")).distinct()


_call = re.compile(r"(?<![\w.])([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\s*\(")
_def = re.compile(r"^(\s*)(?:async\s+)?(def|class)\s+(\w+)")
_from = re.compile(r"^\s*from\s+(\.*[\w.]*)\s+import\s+(.+)$")
_import = re.compile(r"^\s*import\s+(.+)$")


def resolve_from(module: str, base: str, package: bool) -> str:
    """The absolute module of a relative import base."""
    level = len(base) - len(base.lstrip("."))
    if not level:
        return base
    parts = module.split(".")
    parts = parts[: len(parts) - level + (1 if package else 0)]
    return ".".join([*parts, *([base[level:]] if base[level:] else [])])


def calls_of(module: str, path: str, source: str) -> Iterator[tuple[str, str, str]]:
    """(subject, member, backend) of calls, line by line, without a parser: approximate, for sources that need not parse."""
    bound, scopes, package = {}, [], path.endswith("__init__.py")
    for line in source.splitlines():
        if m := _from.match(line):
            base = resolve_from(module, m[1], package)
            for name in m[2].strip("() ").split(","):
                words = name.split()
                if words:
                    bound[words[-1]] = f"{base}.{words[0]}"
        elif m := _import.match(line):
            for name in m[1].split(","):
                words = name.split()
                if words:
                    bound[words[-1]] = words[0]
        m = _def.match(line)
        if line.strip():
            indent = len(line) - len(line.lstrip())
            while scopes and scopes[-1][0] >= indent and not line.lstrip().startswith(")"):
                scopes.pop()
        if m:
            scopes.append((len(m[1]), m[3]))
            continue
        for c in _call.finditer(line):
            head, _, rest = c[1].partition(".")
            if head in bound and scopes:
                yield bound[head] + (f".{rest}" if rest else ""), ".".join([module, *(s for _, s in scopes)]), "approximate"


def approximate_calls(files: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for path, content, module in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in calls_of(module, path, content or "")]
            s, m, b = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (s, m, b)], names=["subject", "member", "backend"])

    named = files.select("path", F.col("content").cast("string"), module_of("path").alias("module")).where("module IS NOT NULL")
    return named.mapInArrow(each, "subject string, member string, backend string").distinct()
