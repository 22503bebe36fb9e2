"""Shared plumbing: shared scratch folder, lineage cuts, places in an order, joins with hot keys, table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows that one task puts in order, about, and most such tasks.
ORDERED, MOST_PARTS = 1_000_000, 20_000
#: A key is hot if it has more than this share of all rows; so there are fewer hot keys than this, whatever the input.
HOT_KEYS = 1000


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is absent, only a ``local`` master, where driver and executors are one process, may use a
    temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="foliospark-")
    return f"{base.rstrip('/')}/foliospark-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path: cuts the lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(df: DataFrame, order: list[Column], position: str = "position") -> tuple[DataFrame, int]:
    """``df`` with each row's zero-based place in ``order``, and the number of rows.

    ``df`` is a written table. It is sorted in ranges; a row's place is its place in the range plus the rows in the
    ranges before, whose counts are one row for each task (at most MOST_PARTS, so they are broadcast). An order whose
    last key differs for all rows lets every hot value be split.
    """
    n = df.count()
    parts = min(MOST_PARTS, max(1, -(-n // ORDERED), df.sparkSession.sparkContext.defaultParallelism))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = materialize(dealt.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn(position, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before"), n


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str, total: int, least: int = 10_000) -> DataFrame:
    """The inner join on ``key``, where ``right`` has one row for each key and, as ``n``, about the rows that ``left``
    has for it. Keys with over ``total`` / HOT_KEYS of them are few and are joined by broadcast, so no task gets all rows
    of a hot key. ``n`` is dropped."""
    limit = max(least, total // HOT_KEYS)
    hot, rest = F.broadcast(right.where(F.col(n) > limit).drop(n)), right.where(F.col(n) <= limit).drop(n)
    if total <= limit:
        return left.join(rest, key)
    return left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key).unionByName(left.join(hot, key))


def floored(x: Column) -> Column:
    """The whole number at or below a double, as a double, which holds it exactly whatever its size."""
    near = F.rint(x)
    return near - F.when(near > x, F.lit(1.0)).otherwise(F.lit(0.0))
