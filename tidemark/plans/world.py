"""A world of two versions made from the test tables, in Spark and, for checks, in SQL.

Documents are files, benchmark items are files that the second version adds, parts are symbols, line items are edges between
symbols and suppliers, customers are artifacts, events are attestations and ledger lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.identity import content_hash
from tidemark.operators import projections


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_files(spark, sf_dir, version: int) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("pkg"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".py").otherwise(".txt"))
    if version == 0:
        return d.select(path.alias("path"), F.col("text").alias("content"))
    kept = d.where("doc_id % 29 <> 0").select(path.alias("path"), F.concat("text", F.when(F.expr("doc_id % 13 = 0"), "#e").otherwise("")).alias("content"))
    new = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("pkgnew/item_"), F.col("item_id").cast("string"), F.lit(".py")).alias("path"), F.col("text").alias("content"))
    return kept.unionByName(new)


def edges(spark, sf_dir, version: int) -> DataFrame:
    """``(relation, subject, member)``: every line item is an edge of one of four relations; the versions differ in two of 61 orders."""
    relation = F.expr("CASE WHEN l_returnflag = 'R' THEN 'callers' WHEN l_returnflag = 'A' THEN 'references' WHEN l_linenumber % 2 = 1 THEN 'implementations' ELSE 'subclasses' END")
    kept = table(spark, sf_dir, "lineitem").where(f"l_orderkey % 61 <> {1 + version}")
    return kept.select(relation.alias("relation"), F.concat(F.lit("part."), F.col("l_partkey").cast("string")).alias("subject"), F.concat(F.lit("supp."), F.col("l_suppkey").cast("string")).alias("member"))


def symbols(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("subject"))


def keys(spark, sf_dir, kind: str) -> DataFrame:
    if kind == "file":
        return projections.keys(source_files(spark, sf_dir, 0).select(F.col("path").alias("subject")), "file")
    return projections.keys(symbols(spark, sf_dir), kind)


def definitions(spark, sf_dir, version: int = 0) -> DataFrame:
    """``p_size`` gives the kind and the place; brand and type make signatures. Every 17th symbol is gone in the second version."""
    p = table(spark, sf_dir, "part")
    if version:
        p = p.where("p_partkey % 17 <> 0")
    symbol = F.concat(F.lit("part."), F.col("p_partkey").cast("string"))
    kind = F.element_at(F.array(*map(F.lit, ["function", "async_function", "method", "async_method", "class", "function"])), F.expr("CAST(p_size % 6 AS INT) + 1"))
    sign = F.when(kind != "class", F.concat(F.lit("(self, size: int = "), F.col("p_size").cast("string"), F.lit(") -> "), F.regexp_replace("p_type", " ", "_")))
    return p.select(symbol.alias("symbol"), kind.alias("kind"), sign.alias("signature"), F.lit("part").alias("module"), F.lit("part.py").alias("path"), F.col("p_size").alias("start_line"), F.lit(0).alias("start_column"))


def imports(spark, sf_dir) -> DataFrame:
    """Nations import their regions."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.lower("r_name").alias("module"), F.concat(F.lit("world."), F.lower("n_name")).alias("target"), F.lower("n_name").alias("binding"), F.expr("n_nationkey % 2 = 0").alias("from_import"))


def environment(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))


def attestations(spark, sf_dir) -> DataFrame:
    """Events as the history of artifacts (users)."""
    e = table(spark, sf_dir, "events")
    authority = F.when(F.expr("event_id % 3 = 0"), "provisional").otherwise("authoritative")
    level = F.element_at(F.array(*map(F.lit, ["unverified", "evidence_backed", "structural", "test", "static", "deterministic"])), F.expr("CAST(event_id % 6 AS INT) + 1"))
    validity = F.element_at(F.array(*map(F.lit, ["VALID", "STALE", "UNKNOWN", "VALID"])), F.expr("CAST(event_id % 4 AS INT) + 1"))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(F.concat(F.lit("att."), F.col("event_id").cast("string")).alias("attestation_id"), F.concat(F.lit("art."), F.col("user_id").cast("string")).alias("artifact_id"), validity.alias("validity"), authority.alias("authority"), level.alias("level"), ms.alias("created_at"))


def artifacts(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("fact."), F.col("c_custkey").cast("string")).alias("artifact_id"), F.when(F.expr("c_custkey % 4 = 0"), "absence-fact.v1").otherwise("set-equality.v1").alias("contract"))


def ordered(spark, sf_dir) -> DataFrame:
    """``(artifact_id, subject)``: the parts that the customers ordered, each pair once."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = o.select("o_orderkey", "o_custkey").join(li.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    # Numbers are shuffled, names are made of what is left.
    rows = rows.select("o_custkey", "l_partkey").distinct().join(table(spark, sf_dir, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return rows.select(F.concat(F.lit("fact."), F.col("o_custkey").cast("string")).alias("artifact_id"), F.concat(F.lit("part."), F.col("l_partkey").cast("string")).alias("subject"))


def dependencies(spark, sf_dir, pairs: DataFrame | None = None) -> DataFrame:
    """Artifacts depend on the callers of the parts that their customers ordered. ``pairs`` is ``ordered``, where that was written already."""
    pairs = ordered(spark, sf_dir) if pairs is None else pairs
    return pairs.select("artifact_id", projections.key_of("subject", "callers").alias("projection_id"))


def values(spark, sf_dir, version: int, relation: str = "callers") -> DataFrame:
    """``(projection_id, subject, value)``."""
    k = keys(spark, sf_dir, relation)
    return projections.relation(k, edges(spark, sf_dir, version), relation).join(k.select("projection_id", "subject"), "projection_id").select("projection_id", "subject", "value")


def observations(spark, sf_dir) -> DataFrame:
    return values(spark, sf_dir, 0).select("projection_id", content_hash("value").alias("digest"), F.lit(1).cast("long").alias("seq"))


#: The same in SQL, each over the ones before it.
CTES = {
    "files0": "SELECT 'pkg'||source||'/doc_'||doc_id||CASE WHEN lang='en' THEN '.py' ELSE '.txt' END AS path, text AS content FROM documents",
    "files1": "SELECT 'pkg'||source||'/doc_'||doc_id||CASE WHEN lang='en' THEN '.py' ELSE '.txt' END AS path, text||CASE WHEN doc_id%13=0 THEN '#e' ELSE '' END AS content FROM documents WHERE doc_id%29<>0 UNION ALL SELECT 'pkgnew/item_'||item_id||'.py', text FROM benchmark",
    "m0": "SELECT path, 'sha256:'||sha256(content) AS digest FROM files0",
    "m1": "SELECT path, 'sha256:'||sha256(content) AS digest FROM files1",
    "changes": "SELECT coalesce(m0.path, m1.path) AS path, CASE WHEN m0.path IS NULL THEN 'added' WHEN m1.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM m0 FULL JOIN m1 ON m0.path = m1.path WHERE m0.digest IS DISTINCT FROM m1.digest",
    "edges0": "SELECT CASE WHEN l_returnflag='R' THEN 'callers' WHEN l_returnflag='A' THEN 'references' WHEN l_linenumber%2=1 THEN 'implementations' ELSE 'subclasses' END AS relation, 'part.'||l_partkey AS subject, 'supp.'||l_suppkey AS member FROM lineitem WHERE l_orderkey%61<>1",
    "edges1": "SELECT CASE WHEN l_returnflag='R' THEN 'callers' WHEN l_returnflag='A' THEN 'references' WHEN l_linenumber%2=1 THEN 'implementations' ELSE 'subclasses' END AS relation, 'part.'||l_partkey AS subject, 'supp.'||l_suppkey AS member FROM lineitem WHERE l_orderkey%61<>2",
    "keys": "SELECT 'part.'||p_partkey AS subject, 'sha256:'||sha256(concat_ws(chr(31),'projection.v1','callers','symbol','part.'||p_partkey,'callers','3')) AS projection_id FROM part",
    "v0": "SELECT keys.projection_id, keys.subject, coalesce(string_agg(DISTINCT member,'; ' ORDER BY member),'') AS value FROM keys LEFT JOIN (SELECT * FROM edges0 WHERE relation='callers') e ON e.subject=keys.subject GROUP BY ALL",
    "v1": "SELECT keys.projection_id, keys.subject, coalesce(string_agg(DISTINCT member,'; ' ORDER BY member),'') AS value FROM keys LEFT JOIN (SELECT * FROM edges1 WHERE relation='callers') e ON e.subject=keys.subject GROUP BY ALL",
    "obs": "SELECT projection_id, 'sha256:'||sha256(value) AS digest FROM v0",
    "defs": "SELECT 'part.'||p_partkey AS symbol, p_partkey, ['function','async_function','method','async_method','class','function'][CAST(p_size%6 AS INT)+1] AS kind, CASE WHEN p_size%6<>4 THEN '(self, size: int = '||p_size||') -> '||replace(p_type,' ','_') END AS signature FROM part",
    "arts": "SELECT 'fact.'||c_custkey AS artifact_id, CASE WHEN c_custkey%4=0 THEN 'absence-fact.v1' ELSE 'set-equality.v1' END AS contract FROM customer",
    "deps": "SELECT DISTINCT 'fact.'||o_custkey AS artifact_id, projection_id FROM orders JOIN lineitem ON o_orderkey=l_orderkey JOIN keys ON keys.subject='part.'||l_partkey",
    "atts": "SELECT 'att.'||event_id AS attestation_id, event_id, 'art.'||user_id AS artifact_id, ['VALID','STALE','UNKNOWN','VALID'][CAST(event_id%4 AS INT)+1] AS validity, CASE WHEN event_id%3=0 THEN 'provisional' ELSE 'authoritative' END AS authority, ['unverified','evidence_backed','structural','test','static','deterministic'][CAST(event_id%6 AS INT)+1] AS level, event_id%6 AS level_rank, CASE WHEN event_id%3=0 THEN 0 ELSE 1 END AS authority_rank, epoch_us(ts)//1000 AS created_at FROM events",
    "seqs": "SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY created_at, attestation_id) AS seq FROM atts",
    "verd": "SELECT projection_id, CASE WHEN CAST(substr(subject,6) AS BIGINT)%37=0 THEN 'unknown' ELSE 'complete' END AS completeness, CASE WHEN CAST(substr(subject,6) AS BIGINT)%41=0 THEN NULL ELSE 'complete' END AS bound FROM keys",
    "outs": "SELECT v1.projection_id, v1.subject, v1.value, 'sha256:'||sha256(v1.value) AS digest, obs.digest AS prior_digest, obs.digest<>'sha256:'||sha256(v1.value) AS value_changed, bound IS DISTINCT FROM completeness AS claim_dirty, completeness FROM v1 JOIN obs USING (projection_id) JOIN verd USING (projection_id)",
    "touched": "SELECT deps.artifact_id, outs.*, arts.contract FROM outs JOIN deps USING (projection_id) JOIN arts ON arts.artifact_id=deps.artifact_id WHERE value_changed OR claim_dirty",
    "contracts": "SELECT artifact_id, contract, count(*) AS touched, bool_and(prior_digest=digest) AS eq, bool_and(value='') AS em, bool_or(completeness='unknown') AS unproven FROM touched GROUP BY ALL",
    "decided": "SELECT artifact_id, contract, touched, CASE WHEN NOT (CASE WHEN contract='set-equality.v1' THEN eq ELSE em END) THEN 'fails' WHEN unproven THEN 'undecidable' ELSE 'holds' END AS verdict FROM contracts",
}


def sql(body: str) -> str:
    """``body`` with the CTEs that it and they name."""
    import re

    names, wanted = list(CTES), set()

    def need(text):
        for n in names:
            if n not in wanted and re.search(rf"\b{n}\b", text):
                wanted.add(n)
                need(CTES[n])

    need(body)
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in names if n in wanted)
    if not head:
        return body
    return f"WITH {head}, {body.lstrip()[5:]}" if body.lstrip().upper().startswith("WITH ") else f"WITH {head} {body}"
