"""Hand-made cases of transitions, histories, syntax, the index, the store and the reuse service."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions import identity as ids
from tidemark.operators import delta, history, measures, semantic, syntax, transition
from tidemark.operators.reuse import Service
from tidemark.sources import tree
from tidemark.sources.store import Store
from tidemark.streaming import ledger


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def decide(spark, value, digest, pinned, contract, completeness="complete", authoritative=True):
    changed = spark.createDataFrame([("p", digest, value, authoritative, completeness)], "projection_id string, digest string, value string, authoritative boolean, completeness string")
    deps = spark.createDataFrame([("a", "p")], "artifact_id string, projection_id string")
    pins = spark.createDataFrame([("a", "p", pinned)] if pinned else [], "artifact_id string, projection_id string, pinned string")
    r = transition.verdicts(changed, deps, pins, spark.createDataFrame([("a", contract)], "artifact_id string, contract string")).first()
    return r["validity"], r["authority"], r["level"]


@pytest.mark.parametrize(
    "args, expected",
    [
        (("x", "d1", "d1", transition.SET_EQUALITY), ("VALID", "authoritative", "structural")),
        (("x", "d2", "d1", transition.SET_EQUALITY), ("STALE", "authoritative", "structural")),
        (("", "d2", "d1", transition.ABSENCE), ("VALID", "authoritative", "structural")),
        (("x", "d2", "d1", transition.ABSENCE), ("STALE", "authoritative", "structural")),
        (("x", "d1", "d1", transition.SET_EQUALITY, "unknown"), ("UNKNOWN", "provisional", "unverified")),
        (("x", "d2", "d1", transition.SET_EQUALITY, "unknown"), ("STALE", "authoritative", "structural")),
        ((None, None, "d1", transition.SET_EQUALITY), ("UNKNOWN", "provisional", "unverified")),
        (("x", "d1", None, transition.SET_EQUALITY), ("UNKNOWN", "provisional", "unverified")),
        (("x", "d1", "d1", None), ("UNKNOWN", "provisional", "unverified")),
        (("x", "d1", "d1", transition.SET_EQUALITY, "complete", False), ("VALID", "provisional", "structural")),
    ],
)
def test_contracts(spark, args, expected):
    assert decide(spark, *args) == expected


def test_outcomes_compare_with_every_earlier_value(spark):
    keys = spark.createDataFrame([(x,) for x in "abcd"], "projection_id string")
    now = spark.createDataFrame([("a", "v", True), ("b", "v", True), ("c", None, True)], "projection_id string, value string, authoritative boolean")
    v = ids.content_hash(F.lit("v"))
    prior = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 1), ("d", 1)], "projection_id string, seq long").withColumn("digest", F.when((F.col("projection_id") == "b") & (F.col("seq") == 1), "old").otherwise(v))
    assert rows(transition.outcomes(keys, now, prior), "projection_id", "outcome") == [("a", "unchanged"), ("b", "changed"), ("c", "unobserved"), ("d", "unobserved")]


def test_empty_delta_touches_nothing(spark):
    none = spark.createDataFrame([], "path string, change string")
    recorded = spark.createDataFrame([("p", "callers", "s", None)], "projection_id string, kind string, subject string, anchor string")
    assert delta.candidates(none, recorded).count() == 0


def test_manifest_conflict_and_environment_guard(spark):
    bad = spark.createDataFrame([("a", "1"), ("a", "2")], "path string, digest string")
    with pytest.raises(Exception, match="two digests"):
        delta.manifest_entries(bad).collect()
    with pytest.raises(Exception, match="bad key"):
        delta.environment(spark.createDataFrame([(" ", "x")], "key string, value string")).collect()
    with pytest.raises(ValueError, match="at least one"):
        delta.environment(spark.createDataFrame([], "key string, value string"))


def test_append_refuses(spark):
    schema = "attestation_id string, artifact_id string, created_at long"
    past = history.sequence(spark.createDataFrame([("1", "a", 5), ("2", "a", 7)], schema), spark.createDataFrame([], schema + ", seq long"))
    known = spark.createDataFrame([("a",)], "artifact_id string")
    assert rows(past, "attestation_id", "seq") == [("1", 1), ("2", 2)]
    for row, why in ((("1", "a", 9), "duplicate"), (("3", "b", 9), "unknown"), (("3", "a", 6), "out of order")):
        with pytest.raises(ValueError, match=why):
            history.append(spark.createDataFrame([row], schema), past, known)
    assert history.append(spark.createDataFrame([("3", "a", 7)], schema), past, known).where("attestation_id = '3'").first()["seq"] == 3


@pytest.mark.parametrize("channels, trust", [([], "unobserved"), (["query_engine"], "complete"), (["query_engine", "declared"], "declared_only"), (["partially_captured", "query_engine"], "partial"), (["unobserved", "query_engine"], "unobserved"), (["fully_intercepted", "query_engine"], "complete"), (["bogus", "query_engine"], "unobserved"), ([None, "query_engine"], "unobserved")])
def test_trust_is_the_weakest_channel(spark, channels, trust):
    df = spark.createDataFrame([(channels,)], "c array<string>")
    assert df.select(history.capture_trust("c")).first()[0] == trust


@pytest.mark.parametrize(
    "source, expected",
    [
        ("def issue_token(user_id: str, ttl_seconds: int | None = None) -> str: ...", "(user_id: str, ttl_seconds: int | None = None) -> str"),
        ("async def fetch(url: str, *, timeout: float = 1.5, **headers: str) -> None: ...", "(url: str, *, timeout: float = 1.5, **headers: str) -> None"),
        ('def combine(*args: int, sep: str = "-", **kw: str) -> str: ...', '(*args: int, sep: str = "-", **kw: str) -> str'),
        ('def f( a :  int ,   b : str="x" ) -> bool :  # styled\n    pass', '(a: int, b: str = "x") -> bool'),
        ("def f(a, /, b, *, kw: int, **opts): ...", "(a, /, b, *, kw: int, **opts)"),
        ("def f(*rest, kw): ...", "(*rest, kw)"),
    ],
)
def test_signatures(source, expected):
    facts = [f for f in syntax.facts_of("m", "m.py", source) if f["fact"] == "definition"]
    assert facts[0]["signature"] == expected


def test_imports_everywhere_and_failed_units():
    text = "import subprocess as sp\nfrom os import path as p, sep\ntry:\n    import a.b\nexcept ImportError:\n    from .x import y\n"
    got = [(f["target"], f["binding"], f["from_import"], f["start_line"]) for f in syntax.facts_of("m", "m.py", text) if f["fact"] == "import"]
    assert got == [("subprocess", "sp", False, 1), ("os.path", "p", True, 2), ("os.sep", "sep", True, 2), ("a.b", "a.b", False, 4), (".x.y", "y", True, 6)]
    failed = list(syntax.facts_of("m", "m.py", "def fragment(  # never closed"))
    assert [f["kind"] for f in failed] == ["failed"]


def test_changed_symbols_of_a_failed_unit_are_unsupported(spark):
    files = spark.createDataFrame([("a.py", "def f(): pass"), ("b.py", "def g(")], "path string, content string")
    facts = syntax.index(files)
    ask = lambda *p: rows(syntax.changed_symbols(spark.createDataFrame([(x,) for x in p], "path string"), syntax.units(facts), syntax.definitions(facts)), "symbol", "proven")
    assert ask("a.py") == [("a.f", True)]
    assert syntax.changed_symbols(spark.createDataFrame([("a.py",), ("b.py",)], "path string"), syntax.units(facts), syntax.definitions(facts)).collect()[0]["proven"] is False


S = "scheme-python pip app 1.0.0 "


def test_index_ingest(spark):
    token, hook = S + "`auth/tokens.py`/refresh_token().", S + "`api/webhooks.py`/handle_refresh()."
    base, sso = S + "`auth/interfaces.py`/AuthProvider#", S + "`auth/sso.py`/SsoProvider#"
    docs = [
        {"language": "python", "relative_path": "api/webhooks.py", "symbols": [{"symbol": hook, "relationships": []}], "occurrences": [{"symbol": hook, "symbol_roles": 1, "range": [5, 4, 9, 60]}, {"symbol": token, "symbol_roles": 0, "range": [7, 11, 40]}]},
        {"language": "Python", "relative_path": "auth/interfaces.py", "symbols": [{"symbol": base, "relationships": []}], "occurrences": []},
        {"language": "python", "relative_path": "auth/sso.py", "symbols": [{"symbol": sso, "relationships": [{"symbol": base, "is_implementation": True, "is_type_definition": False}]}], "occurrences": []},
        {"language": "rust", "relative_path": "x.rs", "symbols": [], "occurrences": []},
    ]
    found = semantic.ingest(spark.createDataFrame(docs, tree.INDEX_SCHEMA))
    assert rows(found["edges"], "relation", "subject", "member") == [
        ("callers", "auth.tokens.refresh_token", "api.webhooks.handle_refresh"),
        ("implementations", "auth.interfaces.AuthProvider", "auth.sso.SsoProvider"),
        ("references", "auth.tokens.refresh_token", "api.webhooks.handle_refresh"),
    ]
    assert found["report"].first().asDict() == {"ingested": 3, "non_python": 1, "references_seen": 1, "relationships_seen": 1}


def test_certificate_and_overlay(spark):
    one = semantic.complete_certificate(spark.createDataFrame([("callers",), ("file",)], "kind string"))
    assert rows(one.select("kind", semantic.completeness("kind").alias("c")), "kind", "c") == [("callers", "complete"), ("file", "complete")]
    assert rows(semantic.with_failed_units(one, ["x.py"]).select("kind", semantic.completeness("kind").alias("c")), "kind", "c") == [("callers", "unknown"), ("file", "complete")]
    frozen = spark.createDataFrame([("s", "m.Class.f"), ("s", "n.g"), ("s", "mm.h")], "subject string, member string")
    live = spark.createDataFrame([("s", "m.new")], "subject string, member string")
    assert rows(semantic.overlay(frozen, live, spark.createDataFrame([("m",)], "module string")), "subject", "member") == [("s", "m.new"), ("s", "mm.h"), ("s", "n.g")]


def test_measures_of_nothing(spark):
    r = measures.confusion(spark.createDataFrame([], "expected string, actual string")).first()
    assert (r["rows"], r["stale_recall"], r["invalidation_precision"]) == (0, 1.0, 1.0)


def write(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


def test_service_round_trip_stale_and_republish(spark, tmp_path):
    root = str(tmp_path / "repo")
    write(root, "auth/tokens.py", "def refresh_token(user):\n    return user\n")
    write(root, "auth/service.py", "from auth.tokens import refresh_token\n\ndef login(u):\n    return refresh_token(u)\n")
    write(root, ".git/x.py", "def no(): pass\n")
    service = Service(spark, root, Store(spark, str(tmp_path / "store")), trust_scan=True)
    assert service.init()["files_indexed"] == 2
    assert service.query("callers", "auth.tokens.refresh_token") == {"backend": "approximate", "value": "auth.service.login"}
    service.publish("k", "callers", "auth.tokens.refresh_token")
    assert service.retrieve("k") == {"verdict": "valid", "explanation": "every dependency is unchanged", "value": "auth.service.login"}
    assert service.retrieve("none")["verdict"] == "unknown"
    assert service.tool("callers", "auth.tokens.refresh_token")["served_from"] == "fresh+captured"
    assert service.tool("callers", "auth.tokens.refresh_token") == {"value": "auth.service.login", "served_from": "reuse"}
    write(root, "api.py", "from auth.tokens import refresh_token as rt\n\ndef handle(u):\n    return rt(u)\n")
    got = service.retrieve("k")
    assert got["verdict"] == "stale" and "value" not in got and "changed" in got["explanation"]
    assert service.retrieve("k")["verdict"] != "valid"
    service.publish("k", "callers", "auth.tokens.refresh_token")
    assert service.retrieve("k")["value"] == "api.handle; auth.service.login"


def test_service_looks_again_at_every_kind_of_view(spark, tmp_path):
    """Modify, add, break and remove a file: never a result that is valid when it should not be."""
    root = str(tmp_path / "repo")
    write(root, "m.py", "import os\n\ndef f(a):\n    return a\n\ndef g():\n    pass\n")
    write(root, "n.py", "def h():\n    pass\n")
    service = Service(spark, root, Store(spark, str(tmp_path / "store")), trust_scan=True)
    service.init()
    for key, kind, subject in (("sig", "signature", "m.f"), ("def", "definition", "m.g")):
        service.publish(key, kind, subject)
    service.publish("note", "note", "what m and n hold", [("imports", "m"), ("file", "n.py"), ("callers", "m.f")])
    with pytest.raises(ValueError, match="cannot be observed"):
        service.publish("x", "signature", "nowhere.f")
    assert service.store.read("bindings").count() == 1 and service.store.read("derivations").where("capture_trust = 'complete'").count() == 2
    assert {r["anchor"] for r in service.store.read("observations").collect()} == {"m.py", "n.py", None}

    write(root, "m.py", "import os, sys\n\ndef f(a, b):\n    return a\n\ndef g():\n    pass\n")
    assert service.status() == {"changed": 1, "artifacts": {"sig": "STALE", "def": "VALID", "note": "STALE"}}
    assert service.retrieve("sig")["verdict"] == "stale"

    write(root, "m.py", "def f(a\n")  # no longer parses: not absent, and nothing is known
    assert service.status()["artifacts"]["def"] == "VALID"  # what cannot be observed takes nothing back
    assert service.retrieve("def")["verdict"] == "unknown"  # but nothing is served

    write(root, "m.py", "import os\n\ndef f(a):\n    return a\n")
    os.remove(os.path.join(root, "n.py"))
    # The signature is pinned to what it last was, and differs from that again.
    assert service.status()["artifacts"] == {"sig": "STALE", "def": "STALE", "note": "STALE"}
    assert service.store.read("bindings").count() == 4  # bound anew under each universe and tree


def test_scan_is_provisional_and_a_broken_file_is_not_complete(spark, tmp_path):
    """A caller that the line scan misses, and a file that does not parse: never a false VALID."""
    root = str(tmp_path / "repo")
    write(root, "m.py", "def f():\n    pass\n")
    write(root, "n.py", "from m import f\n\ndef g():\n    return f()\n")
    service = Service(spark, root, Store(spark, str(tmp_path / "store")))
    service.init()
    service.publish("callers", "callers", "m.f")
    last = service.store.read("attestations").first()
    assert last["authority"] == "provisional" and service.store.read("bindings").first()["completeness"] == "unknown"
    assert service.retrieve("callers")["verdict"] == "unknown"
    write(root, "k.py", "from m import (\n    f,\n)\n\ndef h(): return f()\n")
    assert service.status()["artifacts"]["callers"] != "VALID"
    got = service.retrieve("callers")
    assert got["verdict"] == "unknown" and "value" not in got

    trusting = Service(spark, root, Store(spark, str(tmp_path / "other")), trust_scan=True)
    trusting.init()
    trusting.publish("callers", "callers", "m.f")
    assert trusting.retrieve("callers")["verdict"] == "valid"
    write(root, "broken.py", "def x(:\n")
    assert trusting.status()["artifacts"]["callers"] == "UNKNOWN"


def test_only_changed_files_are_parsed(spark, tmp_path):
    files = [("a/__init__.py", "x = 1"), ("a.py", "def no(): pass"), ("b.py", "import a\n\ndef f(): pass\n"), ("c.py", "def (")]
    frame = lambda rows: spark.createDataFrame(rows, "path string, content string").withColumn("digest", ids.content_hash("content"))
    first = frame(files)
    empty = Store(spark, str(tmp_path / "s"))
    empty.put("facts", syntax.parse_unseen(first, empty.read("facts")))
    files[2] = ("b.py", "def g(): pass\n")
    second = frame(files[1:])  # the package is gone, so a.py is the module now
    assert [r["path"] for r in syntax.unseen(second, empty.read("facts")).collect()] == ["b.py"]
    empty.put("facts", syntax.parse_unseen(second, empty.read("facts")))
    for now in (first, second):
        got, want = syntax.known_facts(now, empty.read("facts")), syntax.index(now)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_store_is_idempotent_and_fails_closed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    blob = spark.createDataFrame([("x",), ("x",)], "content string")
    store.put_blobs(blob)
    store.put_blobs(blob)
    assert store.read("blobs").count() == 1
    spark.createDataFrame([("sha256:bad", bytearray(b"y"))], "blob_id string, content binary").write.mode("append").parquet(str(tmp_path / "s" / "blobs"))
    with pytest.raises(Exception, match="damaged blob"):
        store.get_blobs(store.read("blobs").select("blob_id")).collect()
    spark.createDataFrame([("o", "p", "callers", "s", "repository", "s0", "d", "v", None, 1)], "observation_id string, projection_id string, kind string, subject string, scope string, snapshot_id string, value_digest string, canonical_value string, anchor string, seq long").write.parquet(str(tmp_path / "s" / "observations"))
    with pytest.raises(Exception, match="damaged observation"):
        store.recorded().collect()
    with pytest.raises(ValueError, match="version"):
        spark.createDataFrame([(9,)], "version int").coalesce(1).write.mode("overwrite").json(str(tmp_path / "s" / "_meta"))
        Store(spark, str(tmp_path / "s"))


def test_tree_reads_text_and_excludes(spark, tmp_path):
    write(str(tmp_path), "a/b.py", "é")
    write(str(tmp_path), "node_modules/c.py", "x")
    assert rows(tree.as_text(tree.files(spark, str(tmp_path))), "path", "content") == [("a/b.py", "é")]


def test_ledger_stream(spark, tmp_path):
    write(str(tmp_path), "in/1.json", "\n".join(json.dumps({"ts_ms": 1000 * i, "op": "tool", "tag": "reuse", "elapsed_us": 1}) for i in range(3)))
    got = []
    ledger.run_each(ledger.read(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda df, _: got.append(df.count())).awaitTermination(60)
    assert sum(got) == 3
