"""White space of every kind, and null texts, in the registered query."""

from tidemark.plans import registry


def test_all_documents_are_collapsed(spark, tmp_path):
    texts = ["a\xa0 b", None, "　a\t\x0b\x85 b ", " a\n\nb ", "a​b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in registry.QUERIES["whitespace_collapse"](spark, str(tmp_path)).collect()}
    assert got == {0: "a b", 1: None, 2: "a b", 3: "a b", 4: "a​b"}
