"""What keeps the engine's queries within memory and disk on larger tables: how often an input is read, what a shuffle carries."""

import re

from tests.test_engine import SF
from tidemark.operators import projections, semantic, syntax
from tidemark.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def exchanges(df):
    """Key columns of the plan's shuffles."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan(df))


def test_units_are_parsed_once(spark):
    """Fourteen parses and 52 joins before: each kind looked for the units of its keys, and each use of the facts parsed again."""
    df = registry.views_of_units(spark, SF)
    assert plan(df).count("MapInArrow") == 0  # the facts are read back
    assert len(re.findall(r"\w+Join ", plan(df))) <= 5


def test_local_views_of_all_kinds_at_once(spark):
    """Definition, signature and imports of one name; units that failed or are not there; a file for a module beside its package."""
    files = [("a/b.py", "def f(x):\n    return x\nclass K:\n    pass\n"), ("a/b/__init__.py", "import os\ndef g():\n    pass\n"), ("bad.py", "def (\n"), ("m.py", "import re\n")]
    facts = syntax.index(spark.createDataFrame(files, "path string, content string"))
    k = projections.keys(spark.createDataFrame([("a.b.g",), ("a.b.f",), ("bad.h",), ("gone.x",), ("plain",)], "subject string"), "definition")
    k = k.unionByName(projections.keys(spark.createDataFrame([("a.b.g",), ("a.b.K",)], "subject string"), "signature"))
    k = k.unionByName(projections.keys(spark.createDataFrame([("a.b",), ("m",), ("bad",), ("gone",)], "subject string"), "imports"))
    got = projections.local(k, syntax.definitions(facts), syntax.imports(facts), syntax.units(facts))
    assert {(r["kind"], r["subject"]): (r["value"], r["anchor"]) for r in got.collect()} == {
        ("definition", "a.b.g"): ("function@a.b.g", "a/b/__init__.py"), ("definition", "a.b.f"): ("absent", "a/b/__init__.py"), ("definition", "bad.h"): (None, "bad.py"), ("definition", "gone.x"): (None, None), ("definition", "plain"): (None, None),
        ("signature", "a.b.g"): ("()", "a/b/__init__.py"), ("signature", "a.b.K"): ("absent", "a/b/__init__.py"),
        ("imports", "a.b"): ("os as os (false)", "a/b/__init__.py"), ("imports", "m"): ("re as re (false)", "m.py"), ("imports", "bad"): (None, "bad.py"), ("imports", "gone"): (None, None),
    }


def test_longest_module_in_one_join(spark):
    symbols = spark.createDataFrame([("a.b.c",), ("a.b.c",), ("a.b",), ("a",), ("x.y",)], "symbol string")
    df = semantic.resolve_symbols(symbols, spark.createDataFrame([("a",), ("a.b",), ("a.b.c",)], "module string"))
    assert sorted(map(tuple, df.collect())) == [("a", None, None), ("a.b", "a", "b"), ("a.b.c", "a.b", "c"), ("x.y", None, None)]
    assert len(re.findall(r"\w+Join ", plan(df))) == 1


def test_pins_of_views_observed_once_are_not_grouped(spark):
    """The last observation of each view; ids named twice, views observed twice, an older attestation, ids as text and as bytes."""
    from pyspark.sql import functions as F

    from tidemark.functions import identity as ids
    from tidemark.operators import transition

    a, b = "sha256:" + "a" * 64, "sha256:" + "b" * 64
    obs = spark.createDataFrame([(a, "v1", "d1"), (b, "v2", "d2"), ("o3", "v3", "d3"), ("o4", "v3", "d4")], "observation_id string, projection_id string, digest string")
    att = spark.createDataFrame([("x", 2, [a, "o4", a, "o3", "o4", "?"]), ("x", 1, [b]), ("y", 1, ["o4", b, "o3"])], "artifact_id string, seq long, evidence array<string>")
    wanted = [("x", "v1", "d1"), ("x", "v3", "d4"), ("y", "v2", "d2"), ("y", "v3", "d3")]
    df = transition.pins(att, obs)
    assert sorted(map(tuple, df.collect())) == wanted
    packed = att.withColumn("evidence", F.transform("evidence", lambda x: ids.packed(x)))
    assert sorted(map(tuple, transition.pins(packed, obs.withColumn("observation_id", ids.packed("observation_id"))).collect())) == wanted
    assert not any("observation_id" in x for x in exchanges(df))  # 71 characters of an id; packed ones go


def test_shuffles_of_a_transition_carry_no_digests(spark):
    """Pins and touched views met under artifact and view with their digests and values; both were computed twice for attestations."""
    df = registry._decided(spark, SF)
    by_pair = [x for x in exchanges(df) if "artifact_id" in x and "," in x]
    assert by_pair and all("view" in x and "projection_id" not in x for x in by_pair)
    for q in (registry.transition_attestations, registry.attestation_identity, registry.status):
        assert "o_orderkey" not in plan(q(spark, SF))  # what they read twice was written before: orders and line items are not joined again
