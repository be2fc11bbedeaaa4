"""The pipeline stage by stage, and its queries as registered."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tidemark.llm import queries
from tidemark.llm.common import spill

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spill(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        sizes.append(docs.count())
    texts = [r["text"] for r in docs.collect()]
    assert len(set(texts)) == len(texts) and sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    original = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    for r in docs.collect():  # a text is what it was, but for whole passages that were cut
        assert r["n_chars"] == len(r["text"]) and set(r["text"].split()) <= set(original[r["doc_id"]].split())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = spill(stage(spark, docs, SF), "stage")
        assert docs.count() == 0


def test_stages_on_rows_of_every_kind(spark):
    """Nulls, repeated rows, one id with two texts, a very long text and columns with names that operators use: nothing crashes, clean rows stay."""
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").where("lang = 'en'").orderBy("doc_id").limit(60)
    texts = [r["text"] for r in base.collect() if len(r["text"]) > 300]
    english = max(texts, key=len)
    long = " ".join(f"{w}{i}" for i in range(400) for w in english.split()[:100])
    extra = [(1001, None), (None, None), (1002, ""), (1003, english), (1003, english), (1003, long), (None, english), (1004, "a")]
    rows = [(i, t, "en" if t else None, None, len(t) if t else None) for i, t in extra]
    names = {n: F.lit(1) for n in ("key", "seed", "pos", "id", "bucket", "component", "gone_id", "rows", "spans", "ids", "start")}
    docs = base.unionByName(spark.createDataFrame(rows, base.schema)).withColumns(names)
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spill(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
    left = docs.where("doc_id = 1003 AND text IS NOT NULL").collect()
    assert len(left) <= 1 + (left != []) and sum(len(r["text"]) > 100_000 for r in left) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).where("length < 1").count() == 0


def test_registered(spark):
    names = __spark_entry__.queries()
    assert set(queries.QUERIES) < set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(cursor.fetchall())
