"""All queries of the provenance engine, by name, with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import enums
from tidemark.functions import identity as ids
from tidemark.operators import delta, history, measures, projections, semantic, syntax, transition
from tidemark.plans import world as w
from tidemark.sources import store

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = w.sql(sql)
        return f

    return add


def _s(c) -> F.Column:
    return F.col(c).cast("string")


# Sources, manifests and deltas


@query("SELECT path, digest FROM m0")
def manifest_build(spark, sf):
    return delta.manifest(w.source_files(spark, sf, 0))


@query("SELECT path, digest FROM m0")
def manifest_entries(spark, sf):
    m = delta.manifest(w.source_files(spark, sf, 0))
    return delta.manifest_entries(m.union(m))


MERKLE = (
    "WITH leaf AS (SELECT DISTINCT sha256(concat_ws(chr(31), {columns})) AS leaf FROM {table}), "
    "b AS (SELECT substr(leaf,1,3) AS bucket, sha256(string_agg(leaf, chr(31) ORDER BY leaf)) AS digest, count(*) AS n FROM leaf GROUP BY 1) "
    "SELECT CAST(sum(n) AS BIGINT) AS entries, 'sha256:'||sha256('{tag}'||chr(31)||string_agg(digest, chr(31) ORDER BY bucket)) AS digest FROM b"
)


@query(MERKLE.format(columns="path, digest", table="m0", tag="manifest.v1"))
def manifest_identity(spark, sf):
    return delta.manifest_id(delta.manifest(w.source_files(spark, sf, 0)))


@query("SELECT raw, CASE WHEN starts_with(raw,'/') OR contains(raw,'..') THEN NULL ELSE 'a/'||p_partkey||'/b.py' END AS path FROM (SELECT p_partkey, CASE p_partkey%4 WHEN 0 THEN '/a/'||p_partkey||'/b.py' WHEN 1 THEN './a//'||p_partkey||'/./b.py' WHEN 2 THEN 'a/'||p_partkey||'/../b.py' ELSE 'a/'||p_partkey||'/b.py' END AS raw FROM part)")
def normalize_path(spark, sf):
    k = _s("p_partkey")
    raw = F.when(F.expr("p_partkey % 4 = 0"), F.concat(F.lit("/a/"), k, F.lit("/b.py"))).when(F.expr("p_partkey % 4 = 1"), F.concat(F.lit("./a//"), k, F.lit("/./b.py")))
    raw = raw.when(F.expr("p_partkey % 4 = 2"), F.concat(F.lit("a/"), k, F.lit("/../b.py"))).otherwise(F.concat(F.lit("a/"), k, F.lit("/b.py")))
    return w.table(spark, sf, "part").select(raw.alias("raw")).select("raw", ids.normalize_path("raw").alias("path"))


@query("SELECT n_name AS key, 'sha256:'||sha256(CAST(n_regionkey AS VARCHAR)) AS value_digest FROM nation")
def environment_fingerprint(spark, sf):
    return delta.environment(w.environment(spark, sf))


@query(MERKLE.format(columns="n_name, 'sha256:'||sha256(CAST(n_regionkey AS VARCHAR))", table="nation", tag="environment.v1"))
def environment_identity(spark, sf):
    return delta.environment_id(delta.environment(w.environment(spark, sf)))


@query("SELECT path, change FROM changes")
def reconcile(spark, sf):
    return delta.reconcile(*(delta.manifest(w.source_files(spark, sf, v)) for v in (0, 1)))


@query("SELECT path, 'added' AS change FROM m0")
def reconcile_first_run(spark, sf):
    m = delta.manifest(w.source_files(spark, sf, 0))
    return delta.reconcile(m.limit(0), m)


@query("SELECT change, count(*) AS n FROM changes GROUP BY 1")
def reconcile_summary(spark, sf):
    return reconcile(spark, sf).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN bool_or(path LIKE '%.py') THEN 'python_source' ELSE 'non_python' END AS change_class, count(*) AS changes FROM changes")
def classify_changes(spark, sf):
    return delta.classify(reconcile(spark, sf))


@query("SELECT 'text_only' AS which, CASE WHEN coalesce(bool_or(path LIKE '%.py'),false) THEN 'freeze' ELSE 'reuse' END AS decision FROM changes WHERE path LIKE '%.txt' UNION ALL SELECT 'all', CASE WHEN coalesce(bool_or(path LIKE '%.py'),false) THEN 'freeze' ELSE 'reuse' END FROM changes")
def freeze_decision(spark, sf):
    c = reconcile(spark, sf)
    return delta.freeze_decision(c.where("path LIKE '%.txt'"), True).select(F.lit("text_only").alias("which"), "decision").union(delta.freeze_decision(c, True).select(F.lit("all"), "decision"))


def _recorded(spark, sf) -> DataFrame:
    files = w.keys(spark, sf, "file").withColumn("anchor", F.col("subject"))
    callers = w.keys(spark, sf, "callers").withColumn("anchor", F.lit(None).cast("string"))
    own = w.keys(spark, sf, "definition").withColumn("anchor", F.concat(F.lit("part/"), F.substring("subject", 6, 20), F.lit(".py")))
    return files.unionByName(callers).unionByName(own)


@query("SELECT 'file' AS kind, path AS subject FROM m0 WHERE path IN (SELECT path FROM changes) UNION ALL SELECT 'callers', subject FROM keys WHERE EXISTS (SELECT 1 FROM changes) UNION ALL SELECT 'definition', subject FROM keys WHERE EXISTS (SELECT 1 FROM changes WHERE change<>'modified')")
def candidate_discovery(spark, sf):
    return delta.candidates(reconcile(spark, sf), _recorded(spark, sf)).select("kind", "subject")


@query("SELECT 'file' AS kind, path AS subject FROM m0 WHERE path IN (SELECT path FROM changes WHERE change='modified') UNION ALL SELECT 'callers', subject FROM keys WHERE EXISTS (SELECT 1 FROM changes WHERE change='modified')")
def candidate_discovery_modified_only(spark, sf):
    return delta.candidates(reconcile(spark, sf).where("change = 'modified'"), _recorded(spark, sf)).select("kind", "subject")


def _bindings(spark, sf) -> DataFrame:
    k = w.keys(spark, sf, "callers").withColumn("n", F.substring("subject", 6, 20).cast("long"))
    universe = F.when(F.expr("n % 11 = 0"), "u0").otherwise("u1")
    indexer = F.when(F.expr("n % 13 = 0"), "i0").otherwise("i1")
    return k.where("n % 7 <> 0").select("projection_id", F.lit("s0").alias("snapshot_id"), universe.alias("universe_digest"), F.lit("c1").alias("coverage_digest"), indexer.alias("indexer"), F.lit("complete").alias("completeness"), F.lit(1).cast("long").alias("seq"))


@query("SELECT subject FROM keys WHERE CAST(substr(subject,6) AS BIGINT)%7=0 OR CAST(substr(subject,6) AS BIGINT)%11=0 OR CAST(substr(subject,6) AS BIGINT)%13=0")
def forced_dirty(spark, sf):
    return delta.forced(w.keys(spark, sf, "callers"), _bindings(spark, sf), "u1", "c1", "i1").select("subject")


@query("SELECT projection_id, 'complete' AS completeness, CASE WHEN CAST(substr(subject,6) AS BIGINT)%3=0 THEN 's1' ELSE 's0' END AS snapshot_id FROM keys WHERE CAST(substr(subject,6) AS BIGINT)%7<>0")
def current_bindings(spark, sf):
    b = _bindings(spark, sf)
    third = w.keys(spark, sf, "callers").where(F.substring("subject", 6, 20).cast("long") % 3 == 0).select("projection_id")
    newer = b.join(third, "projection_id", "left_semi").withColumn("snapshot_id", F.lit("s1")).withColumn("seq", F.lit(2).cast("long"))
    return history.current_bindings(b.unionByName(newer)).select("projection_id", "completeness", "snapshot_id")


@query("SELECT DISTINCT artifact_id FROM deps JOIN v0 USING (projection_id) JOIN v1 USING (projection_id) WHERE v0.value<>v1.value")
def dependents(spark, sf):
    return delta.dependents(w.dependencies(spark, sf), transition_outcomes(spark, sf).where("value_changed"))


# Views


@query("SELECT path AS subject, CASE WHEN path LIKE '%.py' THEN coalesce(m1.digest,'absent') END AS value FROM m0 LEFT JOIN m1 USING (path)")
def view_file(spark, sf):
    k = w.keys(spark, sf, "file")
    return projections.file(k, delta.manifest(w.source_files(spark, sf, 1))).join(k, "projection_id").select("subject", "value")


@query("SELECT symbol AS subject, CASE WHEN p_partkey%17=0 THEN 'absent' ELSE kind||'@'||symbol END AS value FROM defs")
def view_definition(spark, sf):
    k = w.keys(spark, sf, "definition")
    return projections.definition(k, w.definitions(spark, sf, 1)).join(k, "projection_id").select("subject", "value")


@query("SELECT symbol AS subject, CASE WHEN p_partkey%17=0 THEN 'absent' ELSE coalesce(signature,'absent') END AS value FROM defs")
def view_signature(spark, sf):
    k = w.keys(spark, sf, "signature")
    return projections.signature(k, w.definitions(spark, sf, 1)).join(k, "projection_id").select("subject", "value")


def _relation(name):
    sql = f"SELECT keys.subject, coalesce(string_agg(DISTINCT member,'; ' ORDER BY member),'') AS value FROM keys LEFT JOIN (SELECT * FROM edges1 WHERE relation='{name}') e ON e.subject=keys.subject GROUP BY ALL"

    def run(spark, sf):
        return w.values(spark, sf, 1, name).select("subject", "value")

    run.__name__ = f"view_{name}"
    query(sql)(run)


for _name in projections.RELATIONS:
    _relation(_name)


@query(
    "WITH leaf AS (SELECT DISTINCT subject, sha256(member) AS leaf FROM edges1 WHERE relation='callers'), b AS (SELECT subject, substr(leaf,1,3) AS k, sha256(string_agg(leaf, chr(31) ORDER BY leaf)) AS d, count(*) AS n FROM leaf GROUP BY 1,2), "
    "s AS (SELECT subject, sum(n) AS n, 'sha256:'||sha256('members.v1'||chr(31)||string_agg(d, chr(31) ORDER BY k)) AS digest FROM b GROUP BY 1) "
    "SELECT keys.subject, CAST(coalesce(n,0) AS BIGINT) AS members, coalesce(digest,'sha256:'||sha256('members.v1'||chr(31))) AS digest FROM keys LEFT JOIN s USING (subject)"
)
def view_callers_digest(spark, sf):
    k = w.keys(spark, sf, "callers")
    return projections.relation_digest(k, w.edges(spark, sf, 1), "callers").join(k, "projection_id").select("subject", "members", "digest")


@query("SELECT lower(r_name) AS subject, string_agg(DISTINCT 'world.'||lower(n_name)||' as '||lower(n_name)||' ('||CASE WHEN n_nationkey%2=0 THEN 'true' ELSE 'false' END||')', '; ' ORDER BY 'world.'||lower(n_name)||' as '||lower(n_name)||' ('||CASE WHEN n_nationkey%2=0 THEN 'true' ELSE 'false' END||')') AS value FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY 1")
def view_imports(spark, sf):
    k = projections.keys(w.table(spark, sf, "region").select(F.lower("r_name").alias("subject")), "imports")
    return projections.imports(k, w.imports(spark, sf)).join(k, "projection_id").select("subject", "value")


SEARCHED = ["License", "token", "the", "no such text"]


@query("SELECT p AS subject, coalesce(string_agg(DISTINCT path,'; ' ORDER BY path) FILTER (contains(content,p)),'') AS value FROM (SELECT unnest(['License','token','the','no such text']) AS p), files1 GROUP BY 1")
def view_repository_search(spark, sf):
    return projections.repository_search(SEARCHED, w.source_files(spark, sf, 1))


def _environment_view(kind):
    def run(spark, sf):
        names = w.table(spark, sf, "nation").select(F.col("n_name").alias("subject")).union(spark.createDataFrame([("UNDECLARED",)], "subject string"))
        k = projections.keys(names, kind)
        return projections.environment_value(k, delta.environment(w.environment(spark, sf))).join(k, "projection_id").select("subject", "value")

    run.__name__ = f"view_{kind}"
    query("SELECT n_name AS subject, 'sha256:'||sha256(CAST(n_regionkey AS VARCHAR)) AS value FROM nation UNION ALL SELECT 'UNDECLARED', 'absent'")(run)


_environment_view("config_value")
_environment_view("tool_version")


@query("SELECT CASE p_partkey%3 WHEN 0 THEN 'Callers(part.'||p_partkey||', Repository)' WHEN 1 THEN 'File(part.'||p_partkey||')' ELSE 'broken '||p_partkey END AS key, CASE p_partkey%3 WHEN 0 THEN 'callers' WHEN 1 THEN 'file' END AS kind, CASE WHEN p_partkey%3<2 THEN 'part.'||p_partkey END AS subject, CASE p_partkey%3 WHEN 0 THEN 'repository' WHEN 1 THEN 'file' END AS scope FROM part")
def parse_projection_key(spark, sf):
    name = F.concat(F.lit("part."), _s("p_partkey"))
    key = F.when(F.expr("p_partkey % 3 = 0"), F.concat(F.lit("Callers("), name, F.lit(", Repository)"))).when(F.expr("p_partkey % 3 = 1"), F.concat(F.lit("File("), name, F.lit(")"))).otherwise(F.concat(F.lit("broken "), _s("p_partkey")))
    return projections.parse_key(w.table(spark, sf, "part").select(key.alias("key")))


@query("SELECT * FROM (VALUES ('file','content','file','file',0,false), ('definition','definition','symbol','repository',3,false), ('signature','signature','symbol','repository',3,false), ('references','references','symbol','repository',3,true), ('callers','callers','symbol','repository',3,true), ('implementations','implementations','symbol','repository',3,true), ('imports','imports','module','module',1,false), ('subclasses','subclasses','symbol','repository',3,true), ('repository_search','matches','text','repository',3,true), ('config_value','value','config_key','repository',3,false), ('tool_version','version','tool','repository',3,false)) t(kind, property, variant, scope, scope_ordinal, completeness_sensitive)")
def projection_kinds(spark, sf):
    return enums.kinds(spark)


@query("SELECT subject, projection_id, 'callers('||subject||', scope=repository)' AS shown FROM keys")
def projection_identity(spark, sf):
    return w.keys(spark, sf, "callers").select("subject", "projection_id", ids.display("kind", "subject", "scope").alias("shown"))


@query("SELECT subject, 'sha256:'||sha256(concat_ws(chr(31),'observation.v1',projection_id,'sha256:'||sha256(value),'s0')) AS observation_id FROM v0")
def observation_identity(spark, sf):
    return w.values(spark, sf, 0).select("subject", ids.observation_id("projection_id", ids.content_hash("value"), F.lit("s0")).alias("observation_id"))


# Relations of an index


@query("SELECT s_suppkey, 'pkg.m'||s_suppkey||'.Class'||CASE WHEN s_suppkey%2=0 THEN '.run' ELSE '' END AS dotted FROM supplier")
def symbol_decode(spark, sf):
    raw = F.concat(F.lit("scheme pip app 1.0.0 `pkg/m"), _s("s_suppkey"), F.lit(".py`/Class#"), F.when(F.expr("s_suppkey % 2 = 0"), "run().").otherwise(""))
    return w.table(spark, sf, "supplier").select("s_suppkey", semantic.dotted(raw).alias("dotted"))


@query("SELECT symbol, CASE WHEN n%3=0 THEN 'own.'||n ELSE 'ext.'||n END AS dotted FROM (SELECT 'sym '||p_partkey AS symbol, p_partkey AS n FROM part)")
def symbol_inventory(spark, sf):
    p = w.table(spark, sf, "part").select(F.concat(F.lit("sym "), _s("p_partkey")).alias("symbol"), F.col("p_partkey").alias("n"))
    return semantic.inventory(p.select("symbol", F.concat(F.lit("ext."), _s("n")).alias("dotted")), p.where("n % 3 = 0").select("symbol", F.concat(F.lit("own."), _s("n")).alias("dotted")))


def _occurrences(spark, sf) -> tuple[DataFrame, DataFrame]:
    li = w.table(spark, sf, "lineitem")
    doc = F.concat(F.lit("doc."), _s("l_orderkey"))
    occ = li.select(F.concat_ws(":", _s("l_orderkey"), _s("l_linenumber")).alias("occ_id"), doc.alias("document"), doc.alias("module"), (F.col("l_partkey") % 90).cast("int").alias("line"))
    defs = li.select(doc.alias("document"), F.concat(doc, F.lit(".f"), _s("l_linenumber")).alias("member"), (F.col("l_suppkey") % 60).cast("int").alias("start_line"), (F.col("l_suppkey") % 60 + F.col("l_quantity")).cast("int").alias("end_line"), F.col("l_linenumber").alias("pos"))
    return occ, defs


ENCLOSING = (
    "WITH o AS (SELECT l_orderkey, l_orderkey||':'||l_linenumber AS occ_id, l_partkey%90 AS line FROM lineitem), "
    "d AS (SELECT l_orderkey, 'doc.'||l_orderkey||'.f'||l_linenumber AS member, l_suppkey%60 AS s, CAST(l_suppkey%60+l_quantity AS INT) AS e, l_linenumber AS pos FROM lineitem), "
    "j AS (SELECT o.occ_id, o.l_orderkey, d.member, row_number() OVER (PARTITION BY o.occ_id ORDER BY d.e-d.s, d.pos) AS rn FROM o LEFT JOIN d ON o.l_orderkey=d.l_orderkey AND o.line BETWEEN d.s AND d.e) "
    "SELECT occ_id, coalesce(member,'doc.'||l_orderkey) AS member FROM j WHERE rn=1"
)


@query(ENCLOSING)
def enclosing_definition(spark, sf):
    return semantic.enclosing(*_occurrences(spark, sf))


@query(
    ENCLOSING.replace("SELECT occ_id, coalesce", "SELECT DISTINCT 'doc.'||CAST(l_orderkey+1 AS BIGINT)||'.g' AS subject, coalesce", 1).replace("WHERE rn=1", "WHERE rn=1 AND CAST(split_part(occ_id,':',2) AS INT)%2=0")
)
def reference_edges(spark, sf):
    occ, defs = _occurrences(spark, sf)
    n = F.split_part("occ_id", F.lit(":"), F.lit(2)).cast("int")
    order = F.split_part("occ_id", F.lit(":"), F.lit(1)).cast("long")
    occ = occ.select("occ_id", "document", "module", "line", F.concat(F.lit("s"), _s("document")).alias("symbol"), (n % 2).alias("roles"), order.alias("k"))
    symbols = occ.select("symbol", F.concat(F.lit("doc."), (F.col("k") + 1).cast("string"), F.lit(".g")).alias("dotted")).distinct()
    return semantic.reference_edges(occ.drop("k"), defs, symbols)


@query("SELECT DISTINCT * FROM (SELECT 'implementations' AS relation, 'k.'||l_partkey AS subject, 'k.'||l_suppkey AS member FROM lineitem WHERE l_linenumber=1 UNION ALL SELECT 'subclasses', 'k.'||l_partkey, 'k.'||l_suppkey FROM lineitem WHERE l_linenumber=2)")
def relationship_edges(spark, sf):
    li = w.table(spark, sf, "lineitem")
    rel = li.select(F.concat(F.lit("s"), _s("l_suppkey")).alias("symbol"), F.concat(F.lit("s"), _s("l_partkey")).alias("target"), (F.col("l_linenumber") == 1).alias("is_implementation"), (F.col("l_linenumber") == 2).alias("is_type_definition"))
    names = rel.select("symbol").union(rel.select("target")).distinct().select("symbol", F.concat(F.lit("k."), F.substring("symbol", 2, 20)).alias("dotted"))
    return semantic.relationship_edges(rel, names)


@query("SELECT 'failed' AS state, count(*) AS failures FROM m1 WHERE path NOT IN (SELECT path FROM m0)")
def index_coverage(spark, sf):
    c = semantic.coverage(*(delta.manifest(w.source_files(spark, sf, v)).select("path") for v in (1, 0)))
    return c.select(F.col("all_units_participated").alias("state"), F.size("failures").cast("long").alias("failures"))


@query(MERKLE.format(columns="path", table="m1", tag="universe.v1"))
def universe_digest(spark, sf):
    return semantic.universe_digest(delta.manifest(w.source_files(spark, sf, 1)).select("path"))


@query(
    "WITH el AS (SELECT DISTINCT sha256(concat_ws(chr(31), relation, subject, member)) AS leaf FROM edges0), eb AS (SELECT substr(leaf,1,3) AS b, sha256(string_agg(leaf, chr(31) ORDER BY leaf)) AS d FROM el GROUP BY 1), "
    "dl AS (SELECT DISTINCT sha256(path) AS leaf FROM m0), db AS (SELECT substr(leaf,1,3) AS b, sha256(string_agg(leaf, chr(31) ORDER BY leaf)) AS d FROM dl GROUP BY 1) "
    "SELECT 'sha256:'||sha256(concat_ws(chr(31),'semantic.v1','textual (scan 1)',(SELECT 'sha256:'||sha256('edges.v1'||chr(31)||string_agg(d,chr(31) ORDER BY b)) FROM eb),(SELECT 'sha256:'||sha256('documents.v1'||chr(31)||string_agg(d,chr(31) ORDER BY b)) FROM db))) AS semantic_snapshot"
)
def semantic_snapshot(spark, sf):
    return semantic.semantic_snapshot(w.edges(spark, sf, 0), delta.manifest(w.source_files(spark, sf, 0)).select("path"), "textual (scan 1)")


@query("SELECT subject, member FROM edges0 WHERE relation='callers' AND CAST(substr(member,6) AS BIGINT)%3<>0 UNION SELECT subject, member FROM edges1 WHERE relation='callers' AND CAST(substr(member,6) AS BIGINT)%3=0")
def provisional_overlay(spark, sf):
    third = "CAST(substring(member, 6) AS BIGINT) % 3 = 0"
    frozen, live = (w.edges(spark, sf, v).where("relation = 'callers'") for v in (0, 1))
    modules = w.table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("supp."), _s("s_suppkey")).alias("module"))
    return semantic.overlay(frozen, live.where(third), modules)


@query("SELECT 'pkg.m'||p_partkey||CASE WHEN p_partkey%2=0 THEN '.sub.Cls.f' ELSE '.f' END AS symbol, CASE WHEN p_partkey%2=0 AND p_partkey%4=0 THEN 'pkg.m'||p_partkey||'.sub' ELSE 'pkg.m'||p_partkey END AS module, CASE WHEN p_partkey%4=0 THEN 'Cls.f' WHEN p_partkey%2=0 THEN 'sub.Cls.f' ELSE 'f' END AS nesting FROM part")
def resolve_symbol(spark, sf):
    p, k = w.table(spark, sf, "part"), _s("p_partkey")
    symbols = p.select(F.concat(F.lit("pkg.m"), k, F.when(F.expr("p_partkey % 2 = 0"), ".sub.Cls.f").otherwise(".f")).alias("symbol"))
    modules = p.select(F.concat(F.lit("pkg.m"), k).alias("module")).union(p.where("p_partkey % 4 = 0").select(F.concat(F.lit("pkg.m"), k, F.lit(".sub"))))
    return semantic.resolve_symbols(symbols, modules)


@query("SELECT path, CASE WHEN path LIKE '%.py' THEN replace(substr(path,1,length(path)-3),'/','.') END AS module FROM m0")
def module_of_path(spark, sf):
    return delta.manifest(w.source_files(spark, sf, 0)).select("path", ids.module_of("path").alias("module"))


# Syntax, over generated source text so that SQL can say what must come out


def _sources(spark, sf) -> DataFrame:
    k, size = _s("p_partkey"), _s("p_size")
    text = F.concat(F.lit("import os.path as p"), k, F.lit("\nfrom .base import Thing"), k, F.lit("\n\nclass C"), k, F.lit(":\n    async def run(self, size: int = "), size, F.lit(', *, name="x") -> bool:\n        return size\n\ndef f'), k, F.lit("(a, /, b):\n    return a\n"))
    broken = F.lit("def broken(  # never closed\n")
    return w.table(spark, sf, "part").select(F.concat(F.lit("src/m"), k, F.lit(".py")).alias("path"), F.when(F.expr("p_partkey % 50 = 0"), broken).otherwise(text).alias("content"))


@query(
    "SELECT 'src.m'||p_partkey||s.symbol_suffix AS symbol, s.kind, s.signature FROM (SELECT p_partkey, unnest([{'symbol_suffix':'.C'||p_partkey,'kind':'class','signature':NULL},{'symbol_suffix':'.C'||p_partkey||'.run','kind':'async_method','signature':'(self, size: int = '||p_size||', *, name=\"x\") -> bool'},{'symbol_suffix':'.f'||p_partkey,'kind':'function','signature':'(a, /, b)'}]) AS s FROM part WHERE p_partkey%50<>0)"
)
def syntax_definitions(spark, sf):
    return syntax.definitions(syntax.index(_sources(spark, sf))).select("symbol", "kind", "signature")


@query("SELECT 'src.m'||p_partkey AS module, 'os.path' AS target, 'p'||p_partkey AS binding, false AS from_import, 1 AS line FROM part WHERE p_partkey%50<>0 UNION ALL SELECT 'src.m'||p_partkey, '.base.Thing'||p_partkey, 'Thing'||p_partkey, true, 2 FROM part WHERE p_partkey%50<>0")
def syntax_imports(spark, sf):
    return syntax.imports(syntax.index(_sources(spark, sf)))


@query("SELECT 'src.m'||p_partkey AS module, CASE WHEN p_partkey%50=0 THEN 'failed' ELSE 'parsed' END AS status FROM part")
def syntax_status(spark, sf):
    return syntax.units(syntax.index(_sources(spark, sf))).select("module", "status")


@query(
    "SELECT 'src.m'||p_partkey||s.symbol_suffix AS symbol, s.kind, s.signature FROM (SELECT p_partkey, unnest([{'symbol_suffix':'.C'||p_partkey,'kind':'class','signature':NULL},{'symbol_suffix':'.C'||p_partkey||'.run','kind':'async_method','signature':'(self, size: int = '||p_size||', *, name=\"x\") -> bool'},{'symbol_suffix':'.f'||p_partkey,'kind':'function','signature':'(a, /, b)'}]) AS s FROM part WHERE p_partkey%50<>0)"
)
def incremental_facts(spark, sf):
    """Facts of a version of which all but one file in fifty were parsed before, equal to those of a whole parse."""
    s = _sources(spark, sf).withColumn("digest", ids.content_hash("content"))
    before = s.where(~F.col("path").rlike("[05]7[.]py$"))
    known = syntax.parse_unseen(before, before.sparkSession.createDataFrame([], f"digest string, {syntax.FIELDS}"))
    both = known.unionByName(syntax.parse_unseen(s, known))
    return syntax.definitions(syntax.known_facts(s, both)).select("symbol", "kind", "signature")


@query("SELECT 'failed' AS units, 'failed' AS refs, count(*) AS failed FROM part WHERE p_partkey%50=0")
def unit_coverage(spark, sf):
    s = _sources(spark, sf)
    c = syntax.unit_coverage(s.select("path"), syntax.units(syntax.index(s)))
    return c.select(F.col("all_units_participated").alias("units"), F.col("resolved_reference_coverage").alias("refs"), "failed")


@query("SELECT 'failed' AS units, 'failed' AS refs, count(*) FILTER (p_partkey%50=0) AS failures FROM part")
def syntax_coverage(spark, sf):
    s = _sources(spark, sf)
    c = syntax.certificate(s.select("path"), syntax.units(syntax.index(s)))
    return c.select(F.col("all_units_participated").alias("units"), F.col("resolved_reference_coverage").alias("refs"), F.size("failures").cast("long").alias("failures"))


@query("SELECT 'src.m'||p_partkey||x AS symbol, true AS proven FROM (SELECT p_partkey, unnest(['.C'||p_partkey, '.C'||p_partkey||'.run', '.f'||p_partkey]) AS x FROM part WHERE p_partkey%50=7)")
def changed_symbols(spark, sf):
    s = _sources(spark, sf)
    facts = syntax.index(s)
    changes = w.table(spark, sf, "part").where("p_partkey % 50 = 7").select(F.concat(F.lit("src/m"), _s("p_partkey"), F.lit(".py")).alias("path"))
    return syntax.changed_symbols(changes, syntax.units(facts), syntax.definitions(facts))


@query()
def approximate_calls(spark, sf):
    k = _s("p_partkey")
    text = F.concat(F.lit("from auth.tokens import refresh as r"), k, F.lit("\n\nasync def handle(u):\n    return r"), k, F.lit("(u)\n"))
    return syntax.approximate_calls(w.table(spark, sf, "part").select(F.concat(F.lit("api/m"), k, F.lit(".py")).alias("path"), text.alias("content")))


ORACLE_SQL["approximate_calls"] = "SELECT 'auth.tokens.refresh' AS subject, 'api.m'||p_partkey||'.handle' AS member, 'approximate' AS backend FROM part"


# Transition


def _verdicts(spark, sf) -> DataFrame:
    k = w.keys(spark, sf, "callers").withColumn("n", F.substring("subject", 6, 20).cast("long"))
    return k.select("projection_id", F.when(F.expr("n % 37 = 0"), "unknown").otherwise("complete").alias("completeness"), F.when(F.expr("n % 41 <> 0"), "complete").alias("bound"))


def _outcomes(spark, sf) -> DataFrame:
    found = delta.candidates(reconcile(spark, sf), w.keys(spark, sf, "callers").withColumn("anchor", F.lit(None).cast("string")))
    evaluated = w.values(spark, sf, 1).select("projection_id", "value", F.lit(True).alias("authoritative"))
    return transition.outcomes(found, evaluated, w.observations(spark, sf), _verdicts(spark, sf))


@query("SELECT projection_id, CASE WHEN value_changed OR claim_dirty THEN 'changed' ELSE 'unchanged' END AS outcome, value, digest, prior_digest, value_changed, claim_dirty, completeness FROM outs")
def transition_outcomes(spark, sf):
    return _outcomes(spark, sf).drop("authoritative")


def _pins(spark, sf, pairs: DataFrame | None = None) -> DataFrame:
    """The base attestation of every artifact pins what each of its views was."""
    return w.dependencies(spark, sf, pairs).join(w.observations(spark, sf), "projection_id").select("artifact_id", "projection_id", F.col("digest").alias("pinned"))


def _decided(spark, sf) -> DataFrame:
    changed, pairs = _outcomes(spark, sf).where("outcome = 'changed'"), _held(w.ordered(spark, sf))
    return transition.verdicts(changed, w.dependencies(spark, sf, pairs), _pins(spark, sf, pairs), w.artifacts(spark, sf))


@query(
    "SELECT artifact_id, contract, verdict, CASE verdict WHEN 'holds' THEN 'VALID' WHEN 'fails' THEN 'STALE' ELSE 'UNKNOWN' END AS validity, CASE WHEN verdict='undecidable' THEN 'provisional' ELSE 'authoritative' END AS authority, "
    "CASE WHEN verdict='undecidable' THEN 'unverified' ELSE 'structural' END AS level, CASE WHEN verdict<>'undecidable' THEN 'sha256:'||sha256('verifier.v1'||chr(31)||contract) END AS verifier, touched FROM decided"
)
def transition_artifacts(spark, sf):
    """The flagship: delta, discovery, evaluation, cutoff at unchanged values, contracts, validity."""
    return _decided(spark, sf)


@query(
    "SELECT artifact_id, CASE verdict WHEN 'holds' THEN 'VALID' WHEN 'fails' THEN 'STALE' ELSE 'UNKNOWN' END AS validity, 1000 + row_number() OVER (ORDER BY substr(sha256(artifact_id),1,3), artifact_id) - 1 AS created_at FROM decided"
)
def transition_attestations(spark, sf):
    none = spark.createDataFrame([], "artifact_id string, evidence array<string>")
    past = spark.createDataFrame([], "attestation_id string")
    return transition.attest(_held(_decided(spark, sf)), none, "s1", 1000, past).select("artifact_id", "validity", "created_at")


@query("SELECT artifact_id, string_agg('dependency callers('||subject||') changed to ['||value||']', '; ' ORDER BY subject) AS explanation FROM touched GROUP BY 1")
def transition_explanation(spark, sf):
    return transition.explain(_outcomes(spark, sf).where("outcome = 'changed'"), w.dependencies(spark, sf), w.keys(spark, sf, "callers"))


@query("SELECT artifact_id, projection_id, 'sha256:'||sha256(value) AS pinned FROM deps JOIN v0 USING (projection_id)")
def pinned_digests(spark, sf):
    own = ids.packed(ids.observation_id("projection_id", ids.content_hash("value"), F.lit("s0")))
    obs = _held(w.values(spark, sf, 0).select(own.alias("observation_id"), "projection_id", ids.content_hash("value").alias("digest")))
    evidence = w.dependencies(spark, sf).join(obs, "projection_id").groupBy("artifact_id").agg(F.array_sort(F.collect_list("observation_id")).alias("evidence"))
    old = evidence.select("artifact_id", F.lit(1).cast("long").alias("seq"), F.array(ids.packed(F.lit("none"))).alias("evidence"))
    return transition.pins(evidence.select("artifact_id", F.lit(2).cast("long").alias("seq"), "evidence").unionByName(old), obs)


@query("SELECT kind, failed, CASE WHEN NOT sensitive OR NOT failed THEN 'complete' ELSE 'unknown' END AS completeness FROM (VALUES ('file',false), ('definition',false), ('signature',false), ('references',true), ('callers',true), ('implementations',true), ('imports',false), ('subclasses',true), ('repository_search',true), ('config_value',false), ('tool_version',false)) t(kind, sensitive), (VALUES (true),(false)) f(failed)")
def completeness(spark, sf):
    whole = semantic.complete_certificate(enums.kinds(spark).select("kind"))
    both = whole.withColumn("failed", F.lit(False)).unionByName(semantic.with_failed_units(whole, ["users/broken.py"]).withColumn("failed", F.lit(True)))
    return both.select("kind", "failed", semantic.completeness("kind").alias("completeness"))


@query("SELECT 'sha256:'||sha256(concat_ws(chr(31),'coverage.v1','established','failed','failed','failed','established','failure:a.py'||chr(31)||'failure:b.py')) AS digest")
def certificate_digest(spark, sf):
    c = semantic.with_failed_units(semantic.complete_certificate(spark.range(1)), ["b.py", "a.py"])
    return c.select(ids.certificate_digest("universe_complete", "all_units_participated", "declaration_inventory_complete", "resolved_reference_coverage", "inheritance_relationships", "failures").alias("digest"))


# Histories


@query("SELECT attestation_id, artifact_id, seq FROM seqs")
def attestation_sequence(spark, sf):
    a = w.attestations(spark, sf)
    return history.sequence(a, a.limit(0).withColumn("seq", F.lit(0).cast("long"))).select("attestation_id", "artifact_id", "seq")


def _history(spark, sf) -> DataFrame:
    a = w.attestations(spark, sf)
    return history.sequence(a, a.limit(0).withColumn("seq", F.lit(0).cast("long")))


@query("SELECT artifact_id, validity FROM seqs QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY seq DESC)=1")
def latest_validity(spark, sf):
    return history.latest_validity(_history(spark, sf))


@query("SELECT artifact_id, attestation_id, validity, authority, level, created_at FROM atts QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY authority_rank DESC, level_rank DESC, created_at DESC, attestation_id DESC)=1")
def strongest_attestation(spark, sf):
    return history.strongest(w.attestations(spark, sf))


@query(
    "SELECT attestation_id, 'duplicate id' AS reason FROM atts WHERE event_id%10=0 UNION ALL SELECT attestation_id, 'out of order' FROM atts a JOIN (SELECT artifact_id, max(created_at) AS m FROM atts WHERE event_id%10=0 GROUP BY 1) USING (artifact_id) WHERE created_at<m UNION ALL SELECT attestation_id, 'unknown artifact' FROM atts WHERE CAST(substr(artifact_id,5) AS BIGINT)%5=0"
)
def append_violations(spark, sf):
    a = w.attestations(spark, sf).withColumn("n", F.substring("attestation_id", 5, 20).cast("long"))
    known = a.where(F.substring("artifact_id", 5, 20).cast("long") % 5 != 0).select("artifact_id").distinct()
    return history.violations(a.drop("n"), a.where("n % 10 = 0").drop("n"), known)


@query("SELECT user_id, CASE WHEN user_id%7=0 THEN 'unobserved' WHEN bool_or(event_id%4=0) THEN 'declared_only' WHEN bool_or(event_id%2=0) THEN 'partial' ELSE 'complete' END AS trust FROM events GROUP BY 1")
def capture_trust(spark, sf):
    e = w.table(spark, sf, "events")
    ch = F.array(F.lit("query_engine"), F.when(F.expr("user_id % 7 = 0"), "nothing known").when(F.expr("event_id % 4 = 0"), "declared").when(F.expr("event_id % 2 = 0"), "partially_captured").otherwise("fully_intercepted"))
    return e.groupBy("user_id").agg(F.flatten(F.collect_set(ch)).alias("channels")).select("user_id", history.capture_trust("channels").alias("trust"))


@query("SELECT attestation_id, validity='VALID' AND authority='authoritative' AS reusable FROM atts")
def auto_reuse(spark, sf):
    return w.attestations(spark, sf).select("attestation_id", history.auto_reuse("validity", "authority", F.lit("partial")).alias("reusable"))


@query("SELECT * FROM (VALUES ('structural_set','A'),('observation','A'),('fact','B'),('derived_fact','B'),('summary','C'),('hypothesis','D'),('plan','E'),('execution_result','F'),('patch','F')) t(kind, reuse_class)")
def reuse_class(spark, sf):
    return spark.createDataFrame([(k,) for k in enums.REUSE], "kind string").select("kind", history.reuse_class("kind").alias("reuse_class"))


# Store


@query("SELECT doc_id, 'sha256:'||sha256(text) AS blob_id FROM documents")
def blob_verify(spark, sf):
    d = w.table(spark, sf, "documents").select("doc_id", ids.content_hash("text").alias("blob_id"), F.col("text").cast("binary").alias("content"))
    return store.verified(d.select("blob_id", "content").distinct()).select("blob_id").join(d.select("doc_id", "blob_id"), "blob_id").select("doc_id", "blob_id")


@query("SELECT DISTINCT 'sha256:'||sha256(text) AS blob_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id%2=0)")
def orphan_blobs(spark, sf):
    d = w.table(spark, sf, "documents").select("doc_id", ids.content_hash("text").alias("blob_id"))
    return store.orphans(d.select("blob_id").distinct(), d.where("doc_id % 2 = 0"))


@query("SELECT DISTINCT 'sha256:'||sha256(text) AS blob_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id%3=0)")
def missing_blobs(spark, sf):
    d = w.table(spark, sf, "documents").select("doc_id", ids.content_hash("text").alias("blob_id"))
    return store.missing(d, d.where("doc_id % 3 = 0"))


@query("SELECT attestation_id, artifact_id, created_at FROM atts WHERE artifact_id='art.7'")
def point_lookup(spark, sf):
    return w.attestations(spark, sf).where("artifact_id = 'art.7'").select("attestation_id", "artifact_id", "created_at")


# Scalars


@query("SELECT p_partkey, CASE WHEN p_partkey%3<2 THEN 'sha256:'||sha256(p_name) END AS hash, CASE WHEN p_partkey%2=0 THEN substr(sha256(p_name),1,40) END AS oid, 'sha256:'||sha256('verifier.v1'||chr(31)||p_name) AS verifier FROM part")
def identifiers(spark, sf):
    h = F.sha2(F.col("p_name").cast("binary"), 256)
    raw = F.when(F.expr("p_partkey % 3 = 0"), F.concat(F.lit("sha256:"), F.upper(h))).when(F.expr("p_partkey % 3 = 1"), F.concat(F.lit("sha256:"), h)).otherwise(F.concat(F.lit("md5:"), h))
    oid = F.when(F.expr("p_partkey % 2 = 0"), F.substring(h, 1, 40)).otherwise(h)
    return w.table(spark, sf, "part").select("p_partkey", ids.parse_hash(raw).alias("hash"), ids.git_oid(oid).alias("oid"), ids.verifier_id("p_name").alias("verifier"))


@query("SELECT p_partkey, CASE p_partkey%3 WHEN 0 THEN p_size ELSE CASE p_partkey%3 WHEN 1 THEN p_size ELSE 0 END END AS start_line, CASE p_partkey%3 WHEN 0 THEN 3 WHEN 1 THEN 3 ELSE 0 END AS start_column, CASE p_partkey%3 WHEN 0 THEN p_size+2 WHEN 1 THEN p_size ELSE 0 END AS end_line, CASE p_partkey%3 WHEN 0 THEN 9 WHEN 1 THEN 9 ELSE 0 END AS end_column FROM part")
def range_normalize(spark, sf):
    s = F.col("p_size").cast("int")
    r = F.when(F.expr("p_partkey % 3 = 0"), F.array(s, F.lit(3), s + 2, F.lit(9))).when(F.expr("p_partkey % 3 = 1"), F.array(s, F.lit(3), F.lit(9))).otherwise(F.array(s))
    return w.table(spark, sf, "part").select("p_partkey", ids.range4(r).alias("r")).select("p_partkey", "r.*")


@query("SELECT doc_id, trim(regexp_replace(text, '[\\x{9}-\\x{D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) AS text FROM documents")
def whitespace_collapse(spark, sf):
    return w.table(spark, sf, "documents").select("doc_id", ids.collapse("text").alias("text"))


@query("SELECT s_suppkey, 'textual (scan '||s_suppkey||')' AS indexer FROM supplier")
def indexer_identity(spark, sf):
    return w.table(spark, sf, "supplier").select("s_suppkey", semantic.indexer_identity(F.lit("textual"), F.lit("scan"), _s("s_suppkey")).alias("indexer"))


@query("SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k, user_id FROM events")
def json_codec(spark, sf):
    e = w.table(spark, sf, "events")
    again = F.from_json(F.to_json(F.struct(F.from_json("props", "k long", {"mode": "FAILFAST"}).alias("cost"), "user_id")), "cost struct<k: long>, user_id long", {"mode": "FAILFAST"})
    return e.select("event_id", again["cost"]["k"].alias("k"), again["user_id"].alias("user_id"))


# Measures


@query("SELECT count(*) AS rows, count(*) FILTER (e=a) AS matches, count(*) FILTER (e<>'VALID' AND a='VALID') AS false_valid, count(*) FILTER (e<>'VALID') AS oracle_invalid, count(*) FILTER (e<>'VALID' AND a<>'VALID')/count(*) FILTER (e<>'VALID') AS stale_recall, count(*) FILTER (e<>'VALID' AND a<>'VALID')/count(*) FILTER (a<>'VALID') AS invalidation_precision, count(*) FILTER (e='UNKNOWN' AND a='UNKNOWN') AS abstention_matches FROM (SELECT validity AS e, CASE WHEN event_id%10=0 THEN 'VALID' ELSE validity END AS a FROM atts)")
def confusion_metrics(spark, sf):
    a = w.attestations(spark, sf)
    return measures.confusion(a.select(F.col("validity").alias("expected"), F.when(F.substring("attestation_id", 5, 20).cast("long") % 10 == 0, "VALID").otherwise(F.col("validity")).alias("actual")))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value)-1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(n) AS n, max(value) FILTER (i=CAST(floor((n-1)*0.5) AS BIGINT)) AS p50, max(value) FILTER (i=CAST(floor((n-1)*0.95) AS BIGINT)) AS p95, max(value) FILTER (i=CAST(floor((n-1)*0.99) AS BIGINT)) AS p99 FROM r GROUP BY 1")
def percentiles(spark, sf):
    return measures.exact_percentile(w.table(spark, sf, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value)-1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(n) AS n, max(value) FILTER (i=CAST(ceil(n*0.5) AS BIGINT)-1) AS p50, max(value) FILTER (i=CAST(ceil(n*0.95) AS BIGINT)-1) AS p95 FROM r GROUP BY 1")
def nearest_rank_percentiles(spark, sf):
    return measures.exact_percentile(w.table(spark, sf, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95}, nearest=True)


@query("WITH r AS (SELECT event_type, value, event_id%7<>0 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY value)-1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), g AS (SELECT event_type AS model, max(n) AS probes, count(*) FILTER (NOT ok) AS failures, max(value) FILTER (i=CAST(ceil(n*0.95) AS BIGINT)-1) AS p95 FROM r GROUP BY 1) SELECT *, failures=0 AND p95<15 AS passed FROM g")
def probe_gate(spark, sf):
    return measures.probe_gate(w.table(spark, sf, "events").select(F.col("event_type").alias("model"), F.expr("event_id % 7 <> 0").alias("ok"), F.col("value").alias("latency_s")))


def _trials(spark, sf) -> DataFrame:
    o = w.table(spark, sf, "orders")
    return o.select(
        (F.col("o_orderkey") % 25).alias("trial"),
        F.when(F.expr("o_custkey % 2 = 0"), "A").otherwise("B").alias("condition"),
        F.col("o_orderpriority").alias("task"),
        F.expr("o_orderkey % 3 <> 0").alias("success"),
        F.col("o_custkey").alias("tokens"),
        F.col("o_orderkey").alias("task_rank"),
    )


TRIALS = "(SELECT o_orderkey%25 AS trial, CASE WHEN o_custkey%2=0 THEN 'A' ELSE 'B' END AS condition, o_orderpriority AS task, o_orderkey%3<>0 AS success, o_custkey AS tokens, o_orderkey AS task_rank FROM orders)"


@query(f"SELECT condition, count(*) AS runs, CAST(sum(tokens) AS BIGINT) AS tokens_total, round(avg(tokens),2) AS tokens_mean FROM {TRIALS} GROUP BY 1")
def condition_summary(spark, sf):
    return measures.summarize(_trials(spark, sf), ["condition"], ["tokens"])


@query(f"SELECT task, avg(tokens) FILTER (condition='A') AS tokens_a, avg(tokens) FILTER (condition='B') AS tokens_b FROM {TRIALS} GROUP BY 1")
def task_breakdown(spark, sf):
    return measures.by_condition(_trials(spark, sf), "tokens")


@query(f"SELECT trial, CAST(coalesce(sum(tokens) FILTER (condition='B'),0) - coalesce(sum(tokens) FILTER (condition='A'),0) AS BIGINT) AS delta FROM {TRIALS} WHERE trial%5<>0 OR condition='A' GROUP BY 1")
def paired_delta(spark, sf):
    return measures.paired_delta(_trials(spark, sf).where("trial % 5 <> 0 OR condition = 'A'"), "tokens")


@query(f"WITH p AS (SELECT max(CAST(success AS INT)) FILTER (condition='A')=1 AS a, coalesce(max(CAST(success AS INT)) FILTER (condition='B'),0)=1 AS b FROM {TRIALS} GROUP BY trial, task HAVING count(*) FILTER (condition='A')>0) SELECT count(*) FILTER (a AND b) AS both_pass, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS both_fail FROM p")
def task_discordance(spark, sf):
    return measures.discordance(_trials(spark, sf))


@query(f"SELECT trial, condition, task_rank, tokens - lag(tokens,1,0) OVER (PARTITION BY trial, condition ORDER BY task_rank) AS tokens_own FROM {TRIALS}")
def ledger_decumulation(spark, sf):
    return measures.decumulate(_trials(spark, sf), "tokens").select("trial", "condition", "task_rank", "tokens_own")


@query("SELECT count(*) FILTER (event_id%7%4=0) AS avoided, count(*) FILTER (event_id%7%4<>0) AS served_fresh, count(*) FILTER (event_id%7%4=2) AS captured, CAST(sum(event_id) AS BIGINT) AS elapsed_us FROM events WHERE event_id%11<>0 AND event_id%5<>0")
def tool_ledger_counters(spark, sf):
    e = w.table(spark, sf, "events")
    tag = F.element_at(F.array(F.lit("reuse"), F.lit(None).cast("string"), F.lit("fresh+captured"), F.lit("unsupported")), F.expr("CAST(event_id % 7 % 4 AS INT) + 1"))
    line = F.to_json(F.struct(F.lit(1).alias("ts_ms"), F.when(F.expr("event_id % 5 = 0"), "publish").otherwise("tool").alias("op"), tag.alias("tag"), F.col("event_id").alias("elapsed_us")))
    return measures.tool_counters(e.select(F.when(F.expr("event_id % 11 = 0"), "{broken").otherwise(line).alias("line")))


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id)=1")
def first_event_wins(spark, sf):
    return measures.first_events(w.table(spark, sf, "events").select(F.col("event_id").alias("line_no"), "event_id", "user_id"), "user_id").select("event_id", "user_id")


@query("SELECT * FROM (VALUES ('few',true,'continue'),('invalid at the cap',false,'last attempt invalid'),('at the cap',false,'attempts exhausted'),('enough',false,'enough valid pairs')) t(which, go_on, reason)")
def accrual_decision(spark, sf):
    n = w.table(spark, sf, "nation").select(F.col("n_nationkey").alias("n"))
    cases = {"few": (4, "n % 3 <> 1"), "invalid at the cap": (8, "n % 3 = 0"), "at the cap": (8, "n % 2 = 1"), "enough": (25, "n % 2 = 0")}
    found = [measures.accrual(n.where(F.col("n") < most).withColumn("valid", F.expr(valid))).select(F.lit(name).alias("which"), "go_on", "reason") for name, (most, valid) in cases.items()]
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query("SELECT n_nationkey, CASE WHEN n_nationkey%3=0 THEN 'PROVIDER_HEALTH_FAILED_BEFORE_PAIR' WHEN n_nationkey%4=0 THEN 'PROVIDER_HEALTH_FAILED_AFTER_PAIR' ELSE 'valid' END AS health FROM nation")
def pair_health(spark, sf):
    return w.table(spark, sf, "nation").select("n_nationkey", measures.pair_health(F.expr("n_nationkey % 3 <> 0"), F.expr("n_nationkey % 4 <> 0")).alias("health"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE)/greatest(p_partkey%3,1) AS ratio FROM part")
def cost_ratio(spark, sf):
    return w.table(spark, sf, "part").select("p_partkey", measures.cost_ratio(F.col("p_size").cast("double"), F.expr("p_partkey % 3")).alias("ratio"))


@query(
    "WITH r AS (SELECT l_orderkey*10+l_linenumber AS seq, l_partkey%40 AS s, l_orderkey%5 AS t, l_orderkey%3 AS f, l_suppkey%2 AS c FROM lineitem), "
    "k AS (SELECT 'fresh' AS strategy, CAST(seq AS VARCHAR) AS key FROM r UNION ALL SELECT 'exact', s||'|'||t FROM r UNION ALL SELECT 'file', s||'|'||f FROM r UNION ALL SELECT 'scoped', s||'|'||c FROM r) "
    "SELECT strategy, count(*) AS requests, count(DISTINCT key) AS recomputations, count(*)-count(DISTINCT key) AS hits FROM k GROUP BY 1"
)
def reuse_ladder(spark, sf):
    r = w.table(spark, sf, "lineitem")
    return measures.ladder(r.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.expr("CAST(l_partkey % 40 AS STRING)").alias("subject"), F.expr("CAST(l_orderkey % 5 AS STRING)").alias("tree_digest"), F.expr("CAST(l_orderkey % 3 AS STRING)").alias("file_digest"), F.expr("CAST(l_suppkey % 2 AS STRING)").alias("scoped_digest")))


# Reuse


@query("SELECT artifact_id, verdict, served FROM (SELECT deps.artifact_id, CASE WHEN bool_and(v0.value=v1.value) THEN 'valid' ELSE 'unknown' END AS verdict, bool_and(v0.value=v1.value) AS served FROM deps JOIN v0 USING (projection_id) JOIN v1 USING (projection_id) GROUP BY 1)")
def retrieve_guard(spark, sf):
    from tidemark.operators import reuse

    pins = _pins(spark, sf)
    now = w.values(spark, sf, 1).select("projection_id", ids.content_hash("value").alias("digest"))
    registry = pins.select("artifact_id").distinct().select("artifact_id", F.lit("VALID").alias("validity"), F.lit("authoritative").alias("authority"), F.lit("complete").alias("trust"))
    return reuse.retrieve(registry, pins, now).select("artifact_id", "verdict", "served")


@query("SELECT keys.subject, v1.value, CASE WHEN v0.value=v1.value THEN 'reuse' ELSE 'fresh+captured' END AS served_from FROM keys JOIN v0 USING (projection_id) JOIN v1 ON v1.projection_id=keys.projection_id")
def tool_lookup(spark, sf):
    from tidemark.operators import reuse

    k = w.keys(spark, sf, "callers")
    cached = w.values(spark, sf, 0).select("projection_id", F.col("value").alias("cached"), ids.content_hash("value").alias("pinned"))
    fresh = w.values(spark, sf, 1).select("projection_id", "value")
    return reuse.tool(k, cached, fresh).select("subject", "value", "served_from")


@query("SELECT subject, CASE kind WHEN 'file' THEN subject WHEN 'definition' THEN 'part/'||substr(subject,6)||'.py' END AS anchor, kind FROM (SELECT path AS subject, 'file' AS kind FROM m0 UNION ALL SELECT subject, 'callers' FROM keys UNION ALL SELECT subject, 'definition' FROM keys)")
def view_anchor(spark, sf):
    r = _recorded(spark, sf).drop("anchor")
    return r.select("subject", transition.anchor("kind", "subject", F.concat(F.lit("part/"), F.substring("subject", 6, 20), F.lit(".py"))).alias("anchor"), "kind")


# Snapshots, trees, costs, garbage


@query(
    "WITH leaf AS (SELECT DISTINCT sha256(concat_ws(chr(31), path, digest)) AS leaf FROM m0), b AS (SELECT substr(leaf,1,3) AS k, sha256(string_agg(leaf, chr(31) ORDER BY leaf)) AS d FROM leaf GROUP BY 1), "
    "el AS (SELECT DISTINCT sha256(concat_ws(chr(31), n_name, 'sha256:'||sha256(CAST(n_regionkey AS VARCHAR)))) AS leaf FROM nation), eb AS (SELECT substr(leaf,1,3) AS k, sha256(string_agg(leaf, chr(31) ORDER BY leaf)) AS d FROM el GROUP BY 1), "
    "i AS (SELECT (SELECT 'sha256:'||sha256('manifest.v1'||chr(31)||string_agg(d,chr(31) ORDER BY k)) FROM b) AS manifest_id, (SELECT 'sha256:'||sha256('environment.v1'||chr(31)||string_agg(d,chr(31) ORDER BY k)) FROM eb) AS environment_id) "
    "SELECT 'sha256:'||sha256(concat_ws(chr(31),'snapshot.v1',manifest_id,environment_id,'~','~','1700000000000')) AS snapshot_id, manifest_id, environment_id FROM i"
)
def snapshot_freeze(spark, sf):
    return delta.freeze(manifest_identity(spark, sf), environment_identity(spark, sf), None, None, 1_700_000_000_000).select("snapshot_id", "manifest_id", "environment_id")


@query("SELECT path, sha256(content) AS digest FROM (SELECT path, CASE WHEN length(content)%7=1 THEN content||'!' ELSE content END AS content FROM files0 WHERE length(content)%7<>0 UNION ALL SELECT 'new/'||path, content FROM files0 WHERE length(content)%7=2)")
def apply_operations(spark, sf):
    f = w.source_files(spark, sf, 0).withColumn("n", F.length("content") % 7)
    gone = f.where("n = 0").select(F.lit("delete_file").alias("op"), "path", F.lit(None).cast("string").alias("content"))
    other = f.where("n = 1").select(F.lit("replace_file").alias("op"), "path", F.concat("content", F.lit("!")).alias("content"))
    new = f.where("n = 2").select(F.lit("add_file").alias("op"), F.concat(F.lit("new/"), "path").alias("path"), "content")
    return delta.apply_operations(f.drop("n"), gone.unionByName(other).unionByName(new)).select("path", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


@query("WITH p AS (SELECT o_orderkey%40 AS pair, sum(o_custkey) FILTER (o_custkey%2=1) - sum(o_custkey) FILTER (o_custkey%2=0) AS d FROM orders WHERE o_orderkey%40%3<>0 GROUP BY 1) SELECT count(*) AS pairs, CAST(median(d) AS DOUBLE) AS median, CAST(avg(d) AS DOUBLE) AS mean FROM p WHERE d IS NOT NULL")
def pair_metric_diffs(spark, sf):
    o = w.table(spark, sf, "orders")
    rows = o.select((F.col("o_orderkey") % 40).alias("pair"), F.when(F.expr("o_custkey % 2 = 0"), "A").otherwise("B").alias("condition"), F.expr("o_orderkey % 40 % 3 <> 0").alias("valid"), F.col("o_custkey").alias("tokens"))
    return measures.pair_metric_diffs(rows, "tokens")


NAMES = ["Read", "Grep", "Glob", "Bash", "Edit", "Write", "ToolSearch", "mcp__service__code_query", "mcp__service__status", "Other"]
EVENTS = (
    "WITH e AS (SELECT event_id AS line_no, CASE WHEN event_id%4=0 THEN 'message' ELSE 'tool' END AS kind, ['Read','Grep','Glob','Bash','Edit','Write','ToolSearch','mcp__service__code_query','mcp__service__status','Other'][CAST(event_id%10 AS INT)+1] AS name, CASE WHEN event_id%9<>0 THEN event_id//12 END AS id, user_id AS i FROM events), "
    "m AS (SELECT * FROM e WHERE kind='message' AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no)=1), t AS (SELECT * FROM e WHERE kind='tool' AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no)=1) "
)


@query(
    EVENTS + "SELECT (SELECT count(*) FROM m) AS model_calls, (SELECT CAST(sum(i) AS BIGINT) FROM m) AS input_tokens, (SELECT CAST(sum(line_no) AS BIGINT) FROM m) AS output_tokens, (SELECT CAST(sum(2*i) AS BIGINT) FROM m) AS cached_read_tokens, (SELECT CAST(sum(3*i) AS BIGINT) FROM m) AS cached_write_tokens, "
    "count(*) AS tool_ops, count(*) FILTER (name='Read') AS file_reads, count(*) FILTER (name IN ('Grep','Glob')) AS repo_searches, count(*) FILTER (name='Bash') AS shell_cmds, count(*) FILTER (name IN ('Edit','Write')) AS edits, count(*) FILTER (name='ToolSearch') AS tool_search_calls, "
    "count(*) FILTER (name='mcp__service__code_query') AS code_query_calls, count(*) FILTER (name='mcp__service__status') AS ceremony_calls FROM t"
)
def event_counters(spark, sf):
    """Lines without an id are skipped; of a message or call that is repeated the first line counts."""
    i, key = F.col("user_id"), F.when(F.expr("event_id % 9 <> 0"), F.expr("event_id div 12"))
    kind = F.when(F.expr("event_id % 4 = 0"), "message").otherwise("tool")
    name = F.element_at(F.array(*map(F.lit, NAMES)), F.expr("CAST(event_id % 10 AS INT) + 1"))
    e = w.table(spark, sf, "events").select(F.col("event_id").alias("line_no"), key.alias("message_id"), key.alias("tool_id"), kind.alias("kind"), name.alias("name"), i.alias("input_tokens"), F.col("event_id").alias("output_tokens"), (2 * i).alias("cached_read_tokens"), (3 * i).alias("cached_write_tokens"))
    return measures.event_counters(e)


@query(
    "SELECT CASE WHEN o_custkey%2=0 THEN 'A' ELSE 'B' END AS condition, CAST(sum(CASE WHEN o_orderkey%3<>0 THEN 1 ELSE 0 END) AS BIGINT) AS success_count, CAST(0 AS BIGINT) AS timeout_count, round(sum(o_custkey*0.5::DOUBLE),1) AS wall_time_s, CAST(sum(o_custkey) AS BIGINT) AS model_calls, "
    "CAST(sum(o_orderkey) AS BIGINT) AS input_tokens, CAST(0 AS BIGINT) AS output_tokens, CAST(sum(2*o_custkey)+sum(o_orderkey) AS BIGINT) AS provider_cached_tokens, CAST(sum(o_custkey%7) AS BIGINT) AS logical_tool_calls, CAST(sum(o_custkey%5) AS BIGINT) AS underlying_computations, "
    "CAST(sum(o_custkey%3) AS BIGINT) AS avoided_computations, CAST(0 AS BIGINT) AS file_reads, CAST(0 AS BIGINT) AS repository_searches, CAST(0 AS BIGINT) AS shell_operations, CAST(0 AS BIGINT) AS automatic_captures, CAST(sum(o_custkey%3) AS BIGINT) AS valid_reuse, "
    "CAST(NULL AS BIGINT) AS stale_withholding, CAST(NULL AS BIGINT) AS unknown_results, CAST(NULL AS BIGINT) AS false_valid_reuse, round(sum(o_custkey)/1e6,3) AS runtime_time_s, CAST(0 AS BIGINT) AS ceremony_calls, CAST(0 AS BIGINT) AS tool_search_calls FROM orders GROUP BY 1"
)
def condition_fields(spark, sf):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    rows = w.table(spark, sf, "orders").select(
        F.when(c % 2 == 0, "A").otherwise("B").alias("condition"), (o % 3 != 0).cast("int").alias("success"), (c * 0.5).alias("wall_clock_s"), c.alias("model_calls"), o.alias("input_tokens"), (2 * c).alias("cached_read_tokens"),
        o.alias("cached_write_tokens"), (c % 7).alias("code_query_calls"), (c % 5).alias("served_fresh"), (c % 3).alias("avoided"), c.alias("validation_us"),
    )
    return measures.condition_fields(rows)


# Entries of the store, of identities and of a whole index


def _scratch(spark) -> str:
    """A new folder that all executors see: under ``spark.checkpoint.dir``, or a temporary one where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}"


def _held(df: DataFrame) -> DataFrame:
    """``df`` written where all executors see it and read back, for what would be computed again at each use."""
    path = _scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("SELECT DISTINCT 'sha256:'||sha256(text) AS blob_id, octet_length(encode(text)) AS n_bytes FROM documents WHERE text IS NOT NULL")
def blob_put(spark, sf):
    """Put twice, there once."""
    kept, contents = store.Store(spark, _scratch(spark)), w.table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("text").alias("content"))
    kept.put_blobs(contents)
    kept.put_blobs(contents)
    return kept.read("blobs").select("blob_id", F.octet_length("content").cast("long").alias("n_bytes"))


@query("SELECT attestation_id, artifact_id, seq FROM seqs")
def store_scan(spark, sf):
    """All attestations from the store in the order of artifact and sequence."""
    kept = store.Store(spark, _scratch(spark))
    none = [F.lit(None).cast("string").alias(n) for n in ("snapshot_id", "verifier")]
    kept.put("attestations", _history(spark, sf).select("*", *none, F.array().cast("array<string>").alias("evidence")))
    return kept.scan("attestations", "artifact_id", "seq").select("attestation_id", "artifact_id", "seq")


@query(
    "SELECT artifact_id, 'sha256:'||sha256(concat_ws(chr(31),'attestation.v1',artifact_id,'s1',CASE verdict WHEN 'holds' THEN 'VALID' WHEN 'fails' THEN 'STALE' ELSE 'UNKNOWN' END,CASE WHEN verdict='undecidable' THEN 'provisional' ELSE 'authoritative' END,"
    "CASE WHEN verdict='undecidable' THEN 'unverified' ELSE 'structural' END,CASE WHEN verdict<>'undecidable' THEN 'sha256:'||sha256('verifier.v1'||chr(31)||contract) ELSE '~' END,'','1000')) AS attestation_id FROM decided"
)
def attestation_identity(spark, sf):
    none, past = spark.createDataFrame([], "artifact_id string, evidence array<string>"), spark.createDataFrame([], "attestation_id string")
    return transition.attest(_held(_decided(spark, sf)), none, "s1", 1000, past).select("artifact_id", "attestation_id")


@query("SELECT subject, 'no source serves callers' AS reason FROM keys")
def unsupported_views(spark, sf):
    """Relations that syntax alone does not serve have no value, not an empty one, and say why."""
    k = w.keys(spark, sf, "callers")
    served = projections.evaluate(k, definitions=w.definitions(spark, sf))
    return projections.unsupported(k, ["file", "definition", "signature", "imports"]).join(served.where("value IS NULL"), "projection_id").join(k, "projection_id").select("subject", "reason")


@query("SELECT kind, subject, CASE WHEN k%50=0 OR subject LIKE 'nowhere%' THEN NULL WHEN kind='signature' AND subject LIKE '%.gone' THEN 'absent' WHEN kind='signature' THEN '(a, /, b)' ELSE '.base.Thing'||k||' as Thing'||k||' (true); os.path as p'||k||' (false)' END AS value, CASE WHEN subject NOT LIKE 'nowhere%' THEN 'src/m'||k||'.py' END AS anchor FROM (SELECT p_partkey AS k, unnest([{'kind':'signature','subject':'src.m'||p_partkey||'.f'||p_partkey},{'kind':'signature','subject':'src.m'||p_partkey||'.gone'},{'kind':'signature','subject':'nowhere.f'||p_partkey},{'kind':'imports','subject':'src.m'||p_partkey}], recursive := true) FROM part)")
def views_of_units(spark, sf):
    """Signatures and imports with their anchors; a unit that does not parse or is not there leaves a view unobserved, never absent."""
    s = _sources(spark, sf)
    facts, n = _held(syntax.index(s)), _s("p_partkey")  # read for units, definitions and imports, parsed once
    p = w.table(spark, sf, "part")
    names = [F.concat(F.lit("src.m"), n, F.lit(".f"), n), F.concat(F.lit("src.m"), n, F.lit(".gone")), F.concat(F.lit("nowhere.f"), n)]
    k = projections.keys(p.select(F.explode(F.array(*names)).alias("subject")), "signature").unionByName(projections.keys(p.select(F.concat(F.lit("src.m"), n).alias("subject")), "imports"))
    return projections.local(k, syntax.definitions(facts), syntax.imports(facts), syntax.units(facts)).select("kind", "subject", "value", "anchor")


@query("SELECT p_partkey, array_to_string(list_sort([p_brand, p_type, p_name]), chr(31)) AS fields, p_brand AS brand, replace('pkg.m'||p_partkey,'.','/')||'.py' AS path FROM part")
def canonical_fields(spark, sf):
    p = w.table(spark, sf, "part")
    brands = [r[0] for r in p.select("p_brand").distinct().limit(100).collect()]  # a closed set
    return p.select("p_partkey", ids.sorted_fields(F.array("p_brand", "p_type", "p_name")).alias("fields"), ids.decode("p_brand", brands, "brand").alias("brand"), ids.path_of(F.concat(F.lit("pkg.m"), _s("p_partkey"))).alias("path"))


def _index(spark, sf) -> DataFrame:
    """An index of one document a supplier: a function that is defined there and uses two names of others, and a class with a base."""
    n = _s("s_suppkey")
    name = lambda path, rest: F.concat(F.lit("scheme pip app 1.0.0 `"), path, F.lit(f".py`/{rest}"))
    own, cls = F.concat(F.lit("m"), n), F.concat(F.lit("m"), n)
    target = name(F.concat(F.lit("t"), F.expr("CAST(s_suppkey % 7 AS STRING)")), "g().")
    base = name(F.lit("base"), "B#")
    relation = F.struct(base.alias("symbol"), F.lit(True).alias("is_implementation"), F.lit(False).alias("is_type_definition"))
    symbols = F.array(F.struct(name(own, "f().").alias("symbol"), F.array().cast("array<struct<symbol: string, is_implementation: boolean, is_type_definition: boolean>>").alias("relationships")), F.struct(name(cls, "C#").alias("symbol"), F.array(relation).alias("relationships")))
    at = lambda symbol, role, *r: F.struct(symbol.alias("symbol"), F.lit(role).alias("symbol_roles"), F.array(*map(F.lit, r)).alias("range"))
    occurrences = F.array(at(name(own, "f()."), 1, 1, 0, 4, 9), at(target, 0, 2, 4, 9), at(base, 0, 8, 4, 9))
    language = F.when(F.expr("s_suppkey % 5 = 0"), "rust").otherwise("Python")
    return w.table(spark, sf, "supplier").select(language.alias("language"), F.concat(own, F.lit(".py")).alias("relative_path"), symbols.alias("symbols"), occurrences.alias("occurrences"))


@query(
    "WITH s AS (SELECT s_suppkey AS n FROM supplier WHERE s_suppkey%5<>0) SELECT r AS relation, 't'||n%7||'.g' AS subject, 'm'||n||'.f' AS member FROM s, (VALUES ('callers'),('references')) t(r) "
    "UNION ALL SELECT r, 'base.B', 'm'||n FROM s, (VALUES ('callers'),('references')) t(r) UNION ALL SELECT 'implementations', 'base.B', 'm'||n||'.C' FROM s"
)
def index_ingest(spark, sf):
    return semantic.ingest(_index(spark, sf))["edges"]


@query("SELECT count(*) FILTER (s_suppkey%5<>0) AS ingested, count(*) FILTER (s_suppkey%5=0) AS non_python, CAST(2*count(*) FILTER (s_suppkey%5<>0) AS BIGINT) AS references_seen, CAST(count(*) FILTER (s_suppkey%5<>0) AS BIGINT) AS relationships_seen FROM supplier")
def index_accounting(spark, sf):
    return semantic.ingest(_index(spark, sf))["report"]


@query("SELECT p_partkey, 0.5*p_size > 3 + p_partkey%5 + 1 + 1 AS stored FROM part")
def materialize_decision(spark, sf):
    p = w.table(spark, sf, "part")
    return p.select("p_partkey", measures.materialize(F.lit(0.5), F.col("p_size"), F.lit(3), F.expr("p_partkey % 5"), F.lit(1), F.lit(1)).alias("stored"))


@query("SELECT blob_id FROM (SELECT 'b'||o_orderkey AS blob_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn>1")
def garbage_blobs(spark, sf):
    o = w.table(spark, sf, "orders")
    name = lambda x: F.concat(F.lit(x), _s("o_orderkey"))
    registry = o.select(_s("o_custkey").alias("key"), name("a").alias("artifact_id"), F.col("o_orderkey").alias("created_at"))
    return store.collectable(o.select(name("b").alias("blob_id")), o.select(name("a").alias("artifact_id"), name("b").alias("payload_ref")), registry)


@query("SELECT key, CASE WHEN bool_or(v0.value IS DISTINCT FROM v1.value) THEN CASE WHEN contract='absence-fact.v1' AND bool_and(v1.value='') FILTER (v0.value IS DISTINCT FROM v1.value) THEN 'VALID' ELSE 'STALE' END ELSE 'VALID' END AS validity FROM (SELECT artifact_id AS key, artifact_id, contract FROM arts) a JOIN deps USING (artifact_id) JOIN v0 USING (projection_id) JOIN v1 USING (projection_id) GROUP BY key, contract")
def status(spark, sf):
    """Latest validity of every key after the delta: what was valid at the base, with what the transition appended."""
    pairs = _held(w.ordered(spark, sf))
    base = pairs.where("artifact_id IS NOT NULL").select("artifact_id").distinct().select("artifact_id", F.lit("VALID").alias("validity"), F.lit(1).cast("long").alias("seq"))
    found = delta.candidates(reconcile(spark, sf), w.keys(spark, sf, "callers").withColumn("anchor", F.lit(None).cast("string")))
    evaluated = w.values(spark, sf, 1).select("projection_id", "value", F.lit(True).alias("authoritative"))
    changed = transition.outcomes(found, evaluated, w.observations(spark, sf)).where("outcome = 'changed'")
    appended = transition.verdicts(changed, w.dependencies(spark, sf, pairs), _pins(spark, sf, pairs), w.artifacts(spark, sf)).select("artifact_id", "validity", F.lit(2).cast("long").alias("seq"))
    return history.latest_validity(base.unionByName(appended)).select(F.col("artifact_id").alias("key"), "validity")
