"""Canonical text forms, identities and small scalar functions, as column expressions.

An identity is ``sha256:<hex>`` over a domain tag and fields joined by U+001F. Inputs must not hold that character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

US = "\u001f"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_hash(content: Column | str) -> Column:
    """``sha256:`` and 64 lower-case hex digits, of text or bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(col(content).cast("binary"), 256))


def canonical(tag: str, *fields: Column | str) -> Column:
    """The tag and the fields joined by U+001F; a null field is ``~``, which no canonical field is."""
    return F.concat_ws(US, F.lit(tag), *[F.coalesce(col(f).cast("string"), F.lit("~")) for f in fields])


def identity(tag: str, *fields: Column | str) -> Column:
    return content_hash(canonical(tag, *fields))


def packed(text: Column | str) -> Column:
    """An identity as 33 bytes for joins and shuffles, other text as its bytes behind a 0: equal if and only if the texts are equal."""
    plain = F.concat(F.lit(bytes([0])), col(text).cast("binary"))
    return F.when(col(text).rlike("^sha256:[0-9a-f]{64}$"), F.concat(F.lit(bytes([1])), F.unhex(F.substring(col(text), 8, 64)))).otherwise(plain)


def parse_hash(text: Column | str) -> Column:
    """A rendered hash in canonical form; upper-case hex is accepted, anything else is null."""
    return F.when(F.lower(col(text)).rlike("^sha256:[0-9a-f]{64}$") & col(text).startswith("sha256:"), F.lower(col(text)))


def git_oid(text: Column | str) -> Column:
    """Forty hex digits in lower case, else null."""
    return F.when(col(text).rlike("^[0-9a-fA-F]{40}$"), F.lower(col(text)))


def sorted_fields(items: Column | str) -> Column:
    """An array of strings as sorted, joined text."""
    return F.array_join(F.array_sort(col(items)), US)


def projection_id(kind, variant, subject, prop, scope_ordinal) -> Column:
    return identity("projection.v1", kind, variant, subject, prop, scope_ordinal)


def observation_id(projection, value_digest, snapshot) -> Column:
    return identity("observation.v1", projection, value_digest, snapshot)


def snapshot_id(manifest, environment, parent, git_commit, created_at) -> Column:
    return identity("snapshot.v1", manifest, environment, parent, git_commit, created_at)


def verifier_id(contract) -> Column:
    return identity("verifier.v1", contract)


def attestation_id(artifact, snapshot, validity, authority, level, verifier, evidence, created_at) -> Column:
    return identity("attestation.v1", artifact, snapshot, validity, authority, level, verifier, evidence, created_at)


def certificate_digest(universe, units, inventory, references, inheritance, failures) -> Column:
    """Five states and the failures, in their order."""
    return identity("coverage.v1", universe, units, inventory, references, inheritance, F.array_join(F.transform(col(failures), lambda f: F.concat(F.lit("failure:"), f)), US))


def display(kind, subject, scope) -> Column:
    return F.format_string("%s(%s, scope=%s)", col(kind), col(subject), col(scope))


def set_digest(rows: DataFrame, *columns: str, tag: str) -> DataFrame:
    """One row ``(entries, digest)`` for the set of rows, in any order of them.

    A Merkle tree of two levels: rows fall into 4096 buckets by their own hash, so no task holds more than a bucket, and
    the digest is that of the ordered bucket digests. Repeated rows count once.
    """
    leaf = rows.select(F.sha2(F.concat_ws(US, *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256).alias("leaf")).distinct()
    buckets = leaf.groupBy(F.substring("leaf", 1, 3).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("leaf")), US), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda b: b["digest"]), US)
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("entries"), content_hash(F.concat_ws(US, F.lit(tag), joined)).alias("digest"))


def normalize_path(path: Column | str) -> Column:
    """A relative path with single ``/`` and without ``.``; null for absolute and empty paths and such with ``..``. A backslash is a character like others."""
    parts = F.filter(F.split(col(path), "/"), lambda p: (p != "") & (p != "."))
    bad = col(path).startswith("/") | F.exists(parts, lambda p: p == "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def module_of(path: Column | str) -> Column:
    """``a/b.py`` and ``a/b/__init__.py`` to ``a.b``; null for what is no module."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(path), r"\.py$", ""), "/", "."), r"\.__init__$", "")
    return F.when(col(path).rlike(r"^([A-Za-z_]\w*/)*[A-Za-z_]\w*\.py$"), name)


def path_of(module: Column | str) -> Column:
    """The plain file of a module; never its ``__init__.py``."""
    return F.concat(F.regexp_replace(col(module), r"\.", "/"), F.lit(".py"))


def collapse(text: Column | str) -> Column:
    """Runs of Unicode white space as one space, trimmed."""
    return F.trim(F.regexp_replace(col(text), r"[\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+", " "))


def range4(items: Column | str) -> Column:
    """A source range of three or four numbers as (start line, start column, end line, end column); others are zeros."""
    r = col(items)

    def pick(three: int, four: int) -> Column:
        return F.when(F.size(r) == 4, F.try_element_at(r, F.lit(four + 1))).when(F.size(r) == 3, F.try_element_at(r, F.lit(three + 1))).otherwise(0)

    return F.struct(pick(0, 0).alias("start_line"), pick(1, 1).alias("start_column"), pick(0, 2).alias("end_line"), pick(2, 3).alias("end_column"))


def set_value(member: Column | str) -> Column:
    """Aggregate: a set of members in canonical form; the empty set is ``''``."""
    return F.array_join(F.array_sort(F.collect_set(col(member))), "; ")


def decode(value: Column | str, known: list[str], name: str) -> Column:
    """A member of a closed set as it is; anything else stops the query."""
    return F.when(col(value).isin(known), col(value)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {name}: "), F.coalesce(col(value), F.lit("null")))))
