"""Connected components of an edge table, and where core operators keep what they write between rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, functions as F


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table below ``spark.checkpoint.dir``, read back: the lineage is cut and lost executors cost a stage.

    Where that setting is absent only a ``local`` master may use a temporary folder.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="foliospark-")
    path = f"{base.rstrip('/')}/foliospark-{uuid.uuid4().hex}/{name}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node of its component.

    Stars are contracted in turn, towards the smallest neighbour: over all neighbours, then over the smaller ones. The
    rounds grow with the logarithm of the nodes. Loops and null ends are left out. Nodes may have any type with an order.
    """
    now = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        new = written(small.distinct(), "edges")
        if new.count() == now.count() and not new.join(now, ["a", "b"], "left_anti").limit(1).count():
            break
        now = new
    return new.select(F.col("a").alias("node"), F.col("b").alias("root")).union(new.select("b", "b").distinct())
