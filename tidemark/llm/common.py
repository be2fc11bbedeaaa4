"""What the operators share: intermediate tables, remainders, connected components."""

from __future__ import annotations

import tempfile
import uuid
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, where that is unset (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage: what follows survives lost executors without computing ``df`` again, and joins between two spilled
    tables are plain enough for adaptive execution to split skewed partitions.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column | str, divisor: int = 3) -> Column:
    """crc32(doc_id as text) mod ``divisor``; null ids count as the text ''. """
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` to ``(node, component)``; the component is its smallest node.

    Every round sends each node to the least of its closed neighbourhood and relabels the edges, so that stars end in
    one round and chains in a logarithmic number of rounds. Aggregates are partial before each shuffle; every table
    that meets a hot node in a join was spilled before, so adaptive execution can split it.
    """
    spark = edges.sparkSession
    edges = spill(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    total = None
    while total is None or not edges.isEmpty():
        near = edges.union(edges.select("v", "u"))
        step = spill(near.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("to")), "step")
        to_u, to_v = step.toDF("u", "mu"), step.toDF("v", "mv")
        moved = edges.join(to_u, "u").select("v", "mu").join(to_v, "v").where("mu <> mv")
        edges = spill(moved.select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct(), "edges")
        if total is None:
            total = step.toDF("node", "component")
        else:
            total = spill(total.join(step.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "total")
    return total
