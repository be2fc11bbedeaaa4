"""Capture and reuse: what the service answers from stored results, set at a time and key by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.enums import KINDS, SCOPES
from tidemark.functions.identity import attestation_id, content_hash, identity, observation_id, projection_id, snapshot_id, verifier_id
from tidemark.operators import delta, history, projections, semantic, syntax, transition
from tidemark.sources import tree
from tidemark.sources.store import Store


def retrieve(registry: DataFrame, pins: DataFrame, current: DataFrame, floor: bool = True) -> DataFrame:
    """``registry(artifact_id, validity, authority, trust)`` to ``(..., verdict, served)``.

    A result is served if it stands above the reuse floor (or, without ``floor``, is just valid) and every digest its payload
    pins is what the view is now; a view that cannot be observed now pins nothing.
    """
    match = pins.join(current, "projection_id", "left").groupBy("artifact_id").agg(F.bool_and(F.coalesce(F.col("pinned") == F.col("digest"), F.lit(False))).alias("pinned"))
    joined = registry.join(match, "artifact_id", "left").withColumn("pinned", F.coalesce("pinned", F.lit(True)))
    stands = history.auto_reuse("validity", "authority", "trust") if floor else F.col("validity") == "VALID"
    verdict = F.when(F.col("validity") == "STALE", "stale").when(stands & F.col("pinned"), "valid").otherwise("unknown")
    return joined.withColumn("verdict", verdict).withColumn("served", verdict == "valid")


def tool(requests: DataFrame, cached: DataFrame, fresh: DataFrame, baseline: bool = False) -> DataFrame:
    """``requests(projection_id, ...)`` answered from ``cached(projection_id, cached, pinned)`` if the pin holds, else from ``fresh(projection_id, value)``."""
    joined = requests.join(fresh, "projection_id", "left").join(cached, "projection_id", "left")
    hit = F.lit(not baseline) & F.coalesce(F.col("pinned") == content_hash("value"), F.lit(False))
    served = F.when(hit, "reuse").otherwise("fresh" if baseline else "fresh+captured")
    return joined.withColumn("served_from", served).withColumn("value", F.when(hit, F.col("cached")).otherwise(F.col("value"))).drop("cached", "pinned")


#: Who answers for the sets of callers and references.
INDEXER = ("textual", "line scan", "1")


class Service:
    """init, status, publish, retrieve, query and tool over a folder of sources and a store.

    Every call reconciles first and runs the transition, publish too, so that a delta is never consumed without its
    results being looked at. A view is observed with its anchor, the path that it was evaluated against, so that a change of that
    path selects it again; a view whose unit does not parse or is not there is unobserved. Views that need a complete
    universe are bound to the universe, the certificate and the indexer they were evaluated under, and looked at again
    when one of these is another. The certificate is made from the tree: a file that does not parse fails it. Callers and
    references come from the approximate line scan, which resolves nothing for certain: what it supports is provisional, its
    completeness is unknown, and nothing that rests on it is served from store, unless the user vouches for it with ``trust_scan``.
    Facts of syntax are stored by path and digest; a call parses only what has changed since. What a result may be trusted
    with comes from the channels of its derivation.
    """

    def __init__(self, spark: SparkSession, root: str, store: Store, trust_scan: bool = False):
        self.spark, self.root, self.store, self.trust_scan = spark, root, store, trust_scan
        self.clock = 0

    def _hold(self, df: DataFrame) -> DataFrame:
        """``df`` as it is now. A cache would do for one call, but Spark would give it to the next one too, after the tree has changed."""
        path = f"{self.store.folder}/_staging/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _files(self) -> DataFrame:
        return tree.as_text(tree.files(self.spark, self.root, suffix=".py", skip_hidden=True))

    def _facts(self, files: DataFrame) -> DataFrame:
        """Facts of ``files(path, content, digest)``; those of files seen before come from the store."""
        self.store.put("facts", syntax.parse_unseen(files, self.store.read("facts")))
        return syntax.known_facts(files, self.store.read("facts"))

    def _evaluate(self, keys: DataFrame) -> DataFrame:
        files = self._hold(self._files().withColumn("digest", content_hash("content")))
        facts = self._facts(files)
        edges = syntax.approximate_calls(files)
        both = edges.select(F.lit("callers").alias("relation"), "subject", "member").unionByName(edges.select(F.lit("references").alias("relation"), "subject", "member"))
        units = syntax.units(facts)
        found = projections.evaluate(keys, delta.manifest(files), syntax.definitions(facts), both, syntax.imports(facts), units=units)
        scanned, local = F.col("kind").isin("callers", "references"), F.col("kind").isin("file", *projections.LOCAL)
        known = projections.anchored(keys.select("projection_id", "kind", "subject"), units).select("projection_id", "kind", "anchor")
        lost = F.raise_error(F.concat(F.lit("a view without an anchor: "), "projection_id"))
        value = F.when(local & F.col("value").isNotNull() & F.col("anchor").isNull(), lost).otherwise(F.col("value"))
        return found.join(known, "projection_id").select("projection_id", value.alias("value"), (~scanned | F.lit(self.trust_scan)).alias("authoritative"), "anchor")

    def _context(self, entries: DataFrame) -> DataFrame:
        """One row: the digests of universe and certificate, and the indexer, that views are bound to."""
        universe = semantic.universe_digest(entries.select("path")).select(F.col("digest").alias("universe_digest"))
        files = self._hold(self._files().withColumn("digest", content_hash("content")))
        # Both sides are one row.
        whole = universe.crossJoin(F.broadcast(syntax.unit_coverage(entries.select("path"), syntax.units(self._facts(files)), "established" if self.trust_scan else "unproven")))
        names = ["universe_complete", "all_units_participated", "declaration_inventory_complete", "resolved_reference_coverage", "inheritance_relationships"]
        complete = F.lit(True)
        for name in ("universe_complete", "all_units_participated", "resolved_reference_coverage"):
            complete &= F.col(name) == "established"
        digest = identity("coverage.v2", *names, "failed", "failures_digest")
        return self._hold(whole.select("universe_digest", digest.alias("coverage_digest"), semantic.indexer_identity(*map(F.lit, INDEXER)).alias("indexer"), F.when(complete, "complete").otherwise("unknown").alias("completeness")))

    def _bind(self, views: DataFrame, context: DataFrame, snapshot: str, now: int) -> None:
        """``views(projection_id, kind)`` that need a complete universe are bound to what they were evaluated under."""
        bound = views.where(projections.sensitive("kind")).select("projection_id").distinct().join(F.broadcast(context))  # one row
        self.store.put("bindings", bound.select("*", F.lit(snapshot).alias("snapshot_id"), F.lit(now).cast("long").alias("seq")))

    def _key(self, kind: str, subject: str) -> DataFrame:
        prop, variant, scope, _ = KINDS[kind]
        row = self.spark.createDataFrame([(kind, subject, scope)], "kind string, subject string, scope string")
        return row.select(projection_id("kind", F.lit(variant), "subject", F.lit(prop), F.lit(SCOPES[scope])).alias("projection_id"), "kind", "subject", "scope")

    def _now(self) -> int:
        last = [self.store.read(table).agg(F.max("created_at")).first()[0] or 0 for table in ("snapshots", "attestations")]
        self.clock = max(self.clock, *last) + 1000
        return self.clock

    def _head(self) -> tuple[str, str] | None:
        row = self.store.read("snapshots").orderBy(F.desc("created_at")).limit(1).first()
        return (row["snapshot_id"], row["manifest_id"]) if row else None

    def reconcile(self) -> tuple[str, int]:
        """The snapshot of the tree as it is, after results that a change touched were looked at; and the number of changes."""
        entries = self._hold(delta.manifest_entries(delta.manifest(self._files())))
        manifest = delta.manifest_id(entries).first()["digest"]
        head = self._head()
        if head and head[1] == manifest:
            return head[0], 0
        now = self._now()
        row = self.spark.createDataFrame([(manifest, "none", head[0] if head else None, None, now)], "manifest_id string, environment_id string, parent_id string, git_commit string, created_at long")
        row = row.withColumn("snapshot_id", snapshot_id("manifest_id", "environment_id", "parent_id", "git_commit", "created_at"))
        snapshot = row.first()["snapshot_id"]
        old = self.store.read("manifests").where(F.col("manifest_id") == (head[1] if head else "")).select("path", "digest")
        changes = self._hold(delta.reconcile(old, entries))
        n = changes.count()
        if head and n:
            self._transition(changes, entries, snapshot, now)
        self.store.put("manifests", entries.select(F.lit(manifest).alias("manifest_id"), "path", "digest"))
        self.store.put("snapshots", row.select("*", F.lit("local").alias("repository_id"), F.lit(None).cast("string").alias("semantic_snapshot")))
        return snapshot, n

    def _transition(self, changes: DataFrame, entries: DataFrame, snapshot: str, now: int) -> None:
        observed = self._hold(self.store.recorded())
        views = self._hold(observed.groupBy("projection_id").agg(F.max_by(F.struct("kind", "subject", "scope", "anchor"), "seq").alias("v")).select("projection_id", "v.*"))
        context, bindings = self._context(entries), history.current_bindings(self.store.read("bindings"))
        under = context.first()
        forced = delta.forced(views.where(projections.sensitive("kind")), bindings, under["universe_digest"], under["coverage_digest"], under["indexer"])
        touched = self._hold(delta.candidates(changes, views).unionByName(forced).dropDuplicates(["projection_id"]))
        evaluated = self._hold(self._evaluate(touched))
        prior = observed.select("projection_id", F.col("value_digest").alias("digest"), "seq")
        standing = touched.where(projections.sensitive("kind")).select("projection_id", F.lit(under["completeness"]).alias("completeness"))
        standing = standing.join(bindings.select("projection_id", F.col("completeness").alias("bound")), "projection_id", "left")
        outcome = self._hold(transition.outcomes(touched, evaluated.drop("anchor"), prior, standing))
        self._bind(touched.join(outcome.where("value IS NOT NULL"), "projection_id", "left_semi"), context, snapshot, now)
        changed = outcome.where("outcome = 'changed'")
        past = self.store.read("attestations")
        pinned = transition.pins(past, observed.select("observation_id", "projection_id", F.col("value_digest").alias("digest")))
        edges = self.store.read("artifact_dependencies")
        decided = self._hold(transition.verdicts(changed, edges, pinned, self.store.read("artifacts")))
        # What was evaluated is observed anew, changed or not, with the anchor it has now.
        new = outcome.where("value IS NOT NULL").join(touched.drop("anchor"), "projection_id").join(evaluated.select("projection_id", "anchor"), "projection_id")
        rows = new.select("outcome", "projection_id", "kind", "subject", "scope", F.lit(snapshot).alias("snapshot_id"), F.col("digest").alias("value_digest"), F.col("value").alias("canonical_value"), "anchor", F.lit(now).cast("long").alias("seq"))
        rows = rows.withColumn("observation_id", observation_id("projection_id", "value_digest", "snapshot_id"))
        # Evidence: the new observation of what changed, and the last pinned one of what did not.
        last = transition.latest(past).select("artifact_id", F.posexplode("evidence").alias("pos", "observation_id")).join(observed.select("observation_id", "projection_id"), "observation_id")
        fresh = edges.join(rows.where("outcome = 'changed'").select("projection_id", F.col("observation_id").alias("fresh")), "projection_id")
        kept = last.join(fresh.select("artifact_id", "projection_id"), ["artifact_id", "projection_id"], "left_anti").select("artifact_id", "observation_id")
        evidence = kept.unionByName(fresh.select("artifact_id", F.col("fresh").alias("observation_id"))).groupBy("artifact_id").agg(F.array_sort(F.collect_list("observation_id")).alias("evidence"))
        attested = self._hold(transition.attest(decided, evidence, snapshot, now, past))
        appended = self._hold(history.admitted(attested, past, self.store.read("artifacts")))
        self.store.put("observations", rows)
        self.store.put("attestations", appended)

    def init(self) -> dict:
        snapshot, n = self.reconcile()
        return {"files_indexed": self._files().count(), "snapshot": snapshot}

    def publish(self, key: str, kind: str, value: str, subjects: list[tuple[str, str]] | None = None) -> dict:
        """Store a result under a key with the views it rests on: by default the one view (kind, value's subject). A view that cannot be observed stops it."""
        snapshot, _ = self.reconcile()
        now = self._now()
        views = [(kind, value)] if subjects is None else subjects
        keys = self._key(*views[0])
        for v in views[1:]:
            keys = keys.unionByName(self._key(*v))
        seen = self._hold(self._evaluate(keys).join(keys, "projection_id"))
        if unseen := seen.where("value IS NULL").limit(1).collect():
            raise ValueError(f"{unseen[0]['kind']}({unseen[0]['subject']}) cannot be observed")
        payload = seen.orderBy("kind", "subject").agg(F.array_join(F.collect_list("value"), "\n")).first()[0] if subjects is None else value
        artifact = f"{key}@{now}"
        rows = seen.select("projection_id", "kind", "subject", "scope", F.lit(snapshot).alias("snapshot_id"), content_hash("value").alias("value_digest"), F.col("value").alias("canonical_value"), "anchor", F.lit(now).cast("long").alias("seq"))
        rows = self._hold(rows.withColumn("observation_id", observation_id("projection_id", "value_digest", "snapshot_id")))
        blob = self.spark.createDataFrame([(payload,)], "content string")
        self.store.put_blobs(blob)
        self.store.put("observations", rows)
        ref = blob.select(content_hash("content")).first()[0]
        made = "structural_set" if all(KINDS[k][3] for k, _ in views) else "observation" if subjects is None else "summary"
        one = self.spark.createDataFrame([(artifact, made, transition.SET_EQUALITY, ref, snapshot, 1, now)], "artifact_id string, kind string, contract string, payload_ref string, created_snapshot string, schema_version int, created_at long")
        one = self._hold(one.withColumn("derivation_id", identity("derivation.v1", F.lit(key), F.lit(now))))
        derived = one.select("derivation_id", F.array(F.lit("query_engine" if subjects is None else "declared")).alias("channels"), "created_at")
        producer = F.struct(F.lit("service").alias("harness"), F.lit("1").alias("version"), F.lit(None).cast("string").alias("model"))
        self.store.put("derivations", derived.select("*", history.capture_trust("channels").alias("capture_trust"), producer.alias("producer")))
        self.store.put("artifacts", one.select("*", F.lit(None).cast("string").alias("proposition"), F.lit(None).alias("cost")))
        context = self._context(self.store.read("manifests").where(F.col("manifest_id") == self._head()[1]))
        self._bind(seen, context, snapshot, now)
        # As in a transition: what needs a complete universe is not decided without one.
        decided = context.first()["completeness"] == "complete" or not any(KINDS[k][3] for k, _ in views)
        self.store.put("artifact_dependencies", rows.select(F.lit(artifact).alias("artifact_id"), "projection_id", F.lit(0).alias("position")))
        authoritative = seen.agg(F.bool_and("authoritative")).first()[0]
        evidence = rows.agg(F.array_sort(F.collect_list("observation_id")).alias("evidence"))
        a = evidence.select(F.lit(artifact).alias("artifact_id"), F.lit(snapshot).alias("snapshot_id"), F.lit("VALID" if decided else "UNKNOWN").alias("validity"), F.lit("authoritative" if authoritative else "provisional").alias("authority"), F.lit("structural" if decided else "unverified").alias("level"), F.when(F.lit(decided), verifier_id(F.lit(transition.SET_EQUALITY))).alias("verifier"), "evidence", F.lit(now).cast("long").alias("created_at"))
        a = self._hold(a.withColumn("attestation_id", attestation_id("artifact_id", "snapshot_id", "validity", "authority", "level", "verifier", F.array_join("evidence", ","), "created_at")))
        self.store.put("attestations", history.admitted(a, self.store.read("attestations"), self.store.read("artifacts")))
        self.store.put("registry", self.spark.createDataFrame([(key, artifact, kind, now)], "key string, artifact_id string, kind string, created_at long"))
        self.log("publish", key, value, "published")
        return {"artifact": artifact, "value": payload}

    def _standing(self) -> DataFrame:
        registry = self.store.read("registry").groupBy("key").agg(F.max_by("artifact_id", "created_at").alias("artifact_id"))
        last = transition.latest(self.store.read("attestations")).select("artifact_id", "validity", "authority")
        made = self.store.read("artifacts").select("artifact_id", "derivation_id").join(self.store.read("derivations").select("derivation_id", F.col("capture_trust").alias("trust")), "derivation_id", "left")
        return registry.join(last, "artifact_id").join(made.select("artifact_id", F.coalesce("trust", F.lit("unobserved")).alias("trust")), "artifact_id", "left")

    def status(self) -> dict:
        _, n = self.reconcile()
        return {"changed": n, "artifacts": {r["key"]: r["validity"] for r in self._standing().collect()}}  # one row a key of this service

    def retrieve(self, key: str) -> dict:
        self.reconcile()
        mine = self._hold(self._standing().where(F.col("key") == key))
        row = mine.first()
        if row is None:
            self.log("retrieve", key, None, "unknown")
            return {"verdict": "unknown", "explanation": "no such key"}
        observed = self.store.recorded()
        first = self.store.read("attestations").where((F.col("artifact_id") == row["artifact_id"]) & (F.col("seq") == 1))
        pins = self._hold(transition.pins(first, observed.select("observation_id", "projection_id", F.col("value_digest").alias("digest"))))
        views = observed.select("projection_id", "kind", "subject", "scope").distinct().join(pins.select("projection_id"), "projection_id", "left_semi")
        now = self._hold(self._evaluate(views).select("projection_id", "value", content_hash("value").alias("digest")))
        verdict = retrieve(mine, pins, now).first()["verdict"]
        moved = pins.join(now, "projection_id").join(views, "projection_id").where("NOT (pinned <=> digest)").select(F.format_string("dependency %s(%s) changed to [%s]", "kind", "subject", F.coalesce("value", F.lit("unobserved")))).collect()
        out = {"verdict": verdict, "explanation": "; ".join(sorted(r[0] for r in moved)) or "every dependency is unchanged"}
        if verdict == "valid":
            ref = self.store.read("artifacts").where(F.col("artifact_id") == row["artifact_id"]).select(F.col("payload_ref").alias("blob_id"))
            out["value"] = bytes(self.store.get_blobs(ref).first()["content"]).decode()
        self.log("retrieve", key, None, verdict)
        return out

    def query(self, kind: str, subject: str) -> dict:
        """Always fresh, nothing stored."""
        backend = "approximate" if kind in ("callers", "references") else "syntax"
        row = self._evaluate(self._key(kind, subject)).first()
        return {"backend": backend, "value": row["value"] if row else None}

    def tool(self, kind: str, subject: str, baseline: bool = False) -> dict:
        """A fresh answer, or a stored one whose pins still hold; a fresh one is captured unless ``baseline``."""
        key = f"{kind}:{subject}"
        if not baseline:
            found = self.retrieve(key)
            if found["verdict"] == "valid":
                self.log("tool", key, subject, "reuse")
                return {"value": found["value"], "served_from": "reuse"}
        value = self.query(kind, subject)["value"]
        served = "fresh"
        if not baseline and value is not None:
            self.publish(key, kind, subject)
            served = "fresh+captured"
        self.log("tool", key, subject, served)
        return {"value": value, "served_from": served}

    def log(self, op: str, key: str | None, subject: str | None, tag: str) -> None:
        self.store.put("ledger", self.spark.createDataFrame([(self.clock, op, key, subject, tag, 0)], "ts_ms long, op string, key string, subject string, tag string, elapsed_us long"))
