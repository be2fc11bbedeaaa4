"""Labels written before the engine ran: nine mutations of a small service, six results each, all in one transition."""

import ast

from pyspark.sql import functions as F

from tidemark.functions.identity import content_hash, module_of
from tidemark.operators import measures, projections, semantic, syntax, transition

BASE = {
    "auth/__init__.py": "",
    "auth/tokens.py": "def issue_token(user_id: str, ttl_seconds: int | None = None) -> str:\n    return user_id\n\n\ndef refresh_token(user_id: str) -> str:\n    return user_id\n",
    "auth/interfaces.py": "class AuthProvider:\n    def validate(self, code: str) -> bool:\n        raise NotImplementedError\n",
    "auth/providers/password.py": "from auth.interfaces import AuthProvider\n\n\nclass PasswordProvider(AuthProvider):\n    def validate(self, code: str) -> bool:\n        return True\n",
    "auth/providers/oauth.py": "from auth.interfaces import AuthProvider\n\n\nclass OAuthProvider(AuthProvider):\n    def validate(self, code: str) -> bool:\n        return True\n",
    "auth/service.py": "class AuthService:\n    def login(self, user):\n        return user\n",
    "users/__init__.py": "",
    "users/service.py": "class UserService:\n    def __init__(self, auth):\n        self._auth = auth\n\n    def enter(self, user):\n        return self._auth.login(user)\n",
    "payments/pricing.py": "CODE = 'SAVE5'\n",
}
HOOK = "from auth.tokens import refresh_token\n\n\ndef handle_refresh(user_id):\n    {}return refresh_token(user_id)\n"
WIDER = BASE["auth/interfaces.py"].replace("code: str)", "code: str, context: dict[str, str] | None = None)")
MUTATIONS = {
    "R1": {"payments/pricing.py": "CODE = 'SAVE10'\n"},
    "R2": {"api/webhooks.py": HOOK.format("")},
    "R3": {"api/webhooks.py": HOOK.format("user_id = user_id.strip()\n    ")},  # after R2
    "R4": {"auth/interfaces.py": WIDER},
    "X1": {"users/alias_caller.py": "from auth.tokens import refresh_token as rotate\n\n\ndef rotate_now(u):\n    return rotate(u)\n"},
    "X2": {"users/__init__.py": "from auth.tokens import refresh_token\n"},
    "X3": {"auth/providers/sso_provider.py": "from auth.interfaces import AuthProvider\n\n\nclass SsoProvider(AuthProvider):\n    pass\n"},
    "X4": {"users/deletion.py": "def delete(u):\n    return None\n"},
    "X5": {"users/broken.py": "def fragment(  # never closed\n    x\n    y\n"},
}
#: artifact: (contract, views)
ARTIFACTS = {
    "CALLERS_REFRESH": (transition.SET_EQUALITY, ["callers:auth.tokens.refresh_token"]),
    "NO_CALLERS_FACT": (transition.ABSENCE, ["callers:auth.tokens.refresh_token"]),
    "PROVIDER_SET": (transition.SET_EQUALITY, ["implementations:auth.interfaces.AuthProvider"]),
    "VALIDATE_SIG": (transition.SET_EQUALITY, ["signature:auth.interfaces.AuthProvider.validate"]),
    "STATELESS": (None, ["signature:auth.service.AuthService.login", "file:auth/service.py"]),
    "LOGIN_CALLERS": (transition.SET_EQUALITY, ["callers:auth.service.AuthService.login"]),
}
#: What is not VALID.
LABELS = {
    "R2": {"CALLERS_REFRESH": "STALE", "NO_CALLERS_FACT": "STALE"},
    "R3": {"NO_CALLERS_FACT": "STALE"},
    "R4": {"VALIDATE_SIG": "STALE"},
    "X1": {"CALLERS_REFRESH": "STALE", "NO_CALLERS_FACT": "STALE"},
    "X3": {"PROVIDER_SET": "STALE"},
    "X5": {"CALLERS_REFRESH": "UNKNOWN", "NO_CALLERS_FACT": "UNKNOWN", "PROVIDER_SET": "UNKNOWN", "LOGIN_CALLERS": "UNKNOWN"},
}


def module(path):
    return path.removesuffix(".py").replace("/", ".").removesuffix(".__init__")


def values(tree):
    """All views of a tree, from the engine's own reading of its sources."""
    signatures, implementors, callers = {}, set(), {}
    for path, text in tree.items():
        for f in syntax.facts_of(module(path), path, text):
            if f["fact"] == "definition" and f["signature"]:
                signatures[f["symbol"]] = f["signature"]
        for subject, member, _ in syntax.calls_of(module(path), path, text):
            callers.setdefault(subject, set()).add(member)
        try:
            nodes = ast.parse(text).body
        except SyntaxError:
            continue
        implementors |= {f"{module(path)}.{n.name}" for n in nodes if isinstance(n, ast.ClassDef) and any(getattr(b, "id", "") == "AuthProvider" for b in n.bases)}
    out = {}
    for _, views in ARTIFACTS.values():
        for view in views:
            kind, subject = view.split(":")
            if kind == "callers":
                out[view] = "; ".join(sorted(callers.get(subject, ())))
            elif kind == "implementations":
                out[view] = "; ".join(sorted(implementors))
            elif kind == "signature":
                out[view] = signatures.get(subject, "absent")
            else:
                out[view] = tree.get(subject, "absent")
    return out


def test_labels(spark):
    base = values(BASE)
    assert base["callers:auth.tokens.refresh_token"] == "" and base["callers:auth.service.AuthService.login"] == ""
    evaluated, prior, pinned, verdicts, edges, artifacts, expected = [], [], [], [], [], [], []
    for name, change in MUTATIONS.items():
        earlier = values(BASE | MUTATIONS["R2"]) if name == "R3" else base
        now = values(BASE | (MUTATIONS["R2"] if name == "R3" else {}) | change)
        broken = name == "X5"
        for view, value in now.items():
            pid = f"{name}|{view}"
            kind = view.split(":")[0]
            evaluated.append((pid, value, True))
            prior += [(pid, base[view], 1)] + [(pid, earlier[view], 2)] * (earlier is not base)
            verdicts.append((pid, kind, broken))
        for artifact, (contract, views) in ARTIFACTS.items():
            aid = f"{name}|{artifact}"
            artifacts.append((aid, contract))
            expected.append((aid, LABELS.get(name, {}).get(artifact, "VALID")))
            for view in views:
                edges.append((aid, f"{name}|{view}"))
                pinned.append((aid, f"{name}|{view}", earlier[view]))
    now = spark.createDataFrame(evaluated, "projection_id string, value string, authoritative boolean")
    was = spark.createDataFrame(prior, "projection_id string, value string, seq long").withColumn("digest", content_hash("value")).drop("value")
    pins = spark.createDataFrame(pinned, "artifact_id string, projection_id string, value string").withColumn("pinned", content_hash("value")).drop("value")
    v = semantic.complete_certificate(spark.createDataFrame(verdicts, "projection_id string, kind string, broken boolean"))
    v = v.where("NOT broken").unionByName(semantic.with_failed_units(v.where("broken"), ["users/broken.py"]))
    v = v.select("projection_id", semantic.completeness("kind").alias("completeness"), F.lit("complete").alias("bound"))
    outcome = transition.outcomes(now, now, was, v)
    decided = transition.verdicts(outcome.where("outcome = 'changed'"), spark.createDataFrame(edges, "artifact_id string, projection_id string"), pins, spark.createDataFrame(artifacts, "artifact_id string, contract string"))
    labelled = spark.createDataFrame(expected, "artifact_id string, expected string").join(decided.select("artifact_id", "validity"), "artifact_id", "left")
    labelled = labelled.withColumn("actual", F.coalesce("validity", F.lit("VALID")))  # untouched results keep their standing
    assert labelled.where("expected <> actual").collect() == []
    m = measures.confusion(labelled).first()
    assert (m["rows"], m["matches"], m["false_valid"], m["oracle_invalid"], m["stale_recall"], m["invalidation_precision"], m["abstention_matches"]) == (54, 54, 0, 11, 1.0, 1.0, 4)


def test_modules_agree(spark):
    paths = [p for p in BASE if p.endswith(".py")]
    got = {r["path"]: r["m"] for r in spark.createDataFrame([(p,) for p in paths], "path string").select("path", module_of("path").alias("m")).collect()}
    assert got == {p: module(p) for p in paths}
    assert projections.RELATIONS
