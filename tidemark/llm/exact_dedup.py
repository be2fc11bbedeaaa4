"""Exact dedup by content-defined chunk recipes (operator 9), in DataFrame functions only.

A text is cut where its content says so: a chunk ends at the first sentence end after ``least`` characters, or after
``most``. Chunks are deduplicated into a dictionary of identifiers (SHA-256), and every identifier is verified: it must
stand for one byte string. A document becomes its ordered list of identifiers, and equal lists mean equal texts, so that
after the dictionary no text moves again. If an identifier is ambiguous (only a weak ``digest`` does that), the text
joins the key and the result is still exact.

Nulls: a null text counts as empty, and all empty texts are equal. A null ``doc_id`` never names the row that stays unless
all its group has none. Repeated rows (same id and text) are one document: both are marked alike, and ``drop_copies`` keeps
one of them. Rows of one id with different texts are different documents. An empty table gives an empty result. Further
columns are ignored by ``exact_dedup`` and kept by ``drop_copies``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import spill


def chunks_of(text: Column, least: int = 512, most: int = 4096) -> Column:
    """Whole ``text`` as an array of chunks; sentence ends and line ends are the only cut marks, so equal passages meet again."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least}}}.{{0,{most - least - 1}}}?[.!?\n]|.{{1,{most}}}"), F.lit(0))


def sha256(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk.cast("binary"), 256))


def ambiguous_identifiers(texts: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Identifiers that stand for more than one chunk. ``texts(text)``; every distinct chunk moves once, copies are merged before the shuffle."""
    dictionary = texts.select(F.explode(chunks_of(F.col("text"))).alias("chunk")).select(digest(F.col("chunk")).alias("cid"), "chunk").distinct()
    return dictionary.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cid")


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``."""
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    verified = ambiguous_identifiers(texts, digest).isEmpty()
    recipe = F.transform(chunks_of(F.col("text")), digest)
    key = recipe if verified else F.struct(recipe, "text")
    keyed = spill(texts.select("doc_id", key.alias("key"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")), "recipes")
    # Groups of one need no partner. The rest is spilled, so the join below is plain and a hot group is split by AQE.
    groups = spill(keyed.groupBy("key").agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("size")).where("size > 1"), "groups")
    keep_id = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("last"))
    return (
        keyed.join(groups, "key", "left")
        .withColumn("keep_id", keep_id)
        .select("doc_id", "keep_id", F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows of equal text but the one with the largest ``doc_id``; of repeated rows, and of copies without an id, one stays.

    A row goes by its id and text, so that another text of the same id is left alone.
    """
    digest = f"__digest_{'_'.join(docs.columns)}"  # no column of ``docs``
    found = spill(exact_dedup(docs), "exact")
    pair = [F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha256")]
    gone = spill(found.where("not kept").select(*pair).distinct(), "gone")
    again = spill(found.where("kept AND group_size > 1").groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "again")
    own = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    same = lambda t: own["doc_id"].eqNullSafe(t["gone_id"]) & (own[digest] == t["gone_sha256"])
    left = own.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return left.drop(digest)
    once = left.join(again, same(again), "left_semi").dropDuplicates(["doc_id", digest])
    return left.join(again, same(again), "left_anti").unionByName(once).drop(digest)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       CAST(count(*) OVER (PARTITION BY coalesce(text, '')) AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
