"""Cutting lineage: iterative operators keep their state in the cluster's shared folder. Sizing of large shuffles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: MB of the files read for each partition of a large shuffle.
SHARD_MB = 4
#: MB of files below which what is read from them alone may be broadcast.
SMALL_MB = 1


def shared_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet where every executor can read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_mb(df: DataFrame) -> float | None:
    """MB of the files that ``df`` reads, each scan counted; None where some input is no file."""
    leaves, total = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        size = int(str(leaves.apply(i).stats().sizeInBytes()))
        if size >= 1 << 60:
            return None
        total += size
    return total / 2**20


def shards(*tables: DataFrame) -> int:
    """Partitions for a shuffle of rows made from ``tables``: in proportion to their files, 1 where these aren't known."""
    return 1 + int(sum(input_mb(t) or 0 for t in tables) / SHARD_MB)


def spread(df: DataFrame, n: int, *by: str) -> DataFrame:
    """``df`` parted by some columns over ``n`` partitions, or the session's number where that is more.

    What a task holds then doesn't grow with the input, and a join on the columns or an
    aggregate by them and others needs no other shuffle.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *by) if n > least else df.repartition(*by)


def is_small(df: DataFrame) -> bool:
    size = input_mb(df)
    return size is not None and size <= SMALL_MB
