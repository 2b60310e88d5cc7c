"""File-store operators: roots, eviction, orphans, cache validity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lru_evict(files: DataFrame, cap: int, shards: int = 1024) -> DataFrame:
    """Files to drop, oldest first by (mtime, size, path), until the rest fits ``cap``.

    The running total goes over time buckets first, so that only a bucket is sorted by one task."""
    total = files.agg(F.sum("size").alias("total"))
    f = files.withColumn("bucket", F.floor(F.col("mtime") / shards))
    per = f.groupBy("bucket").agg(F.sum("size").alias("s"))
    before = per.withColumn("base", F.sum("s").over(W.orderBy("bucket")) - F.col("s")).select(F.col("bucket").alias("b"), "base")
    w = W.partitionBy("bucket").orderBy("mtime", "size", "path")
    run = f.join(before, F.col("bucket") == F.col("b")).withColumn("sum_before", F.col("base") + F.sum("size").over(w) - F.col("size"))
    return run.join(F.broadcast(total)).where(F.col("total") - F.col("sum_before") > cap).select("path", "size", "mtime")


def orphans(files: DataFrame, references: DataFrame) -> DataFrame:
    """Stored roots that no document names."""
    return files.groupBy("root").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes")).join(references.select("root").distinct(), "root", "left_anti")


def spend(readings: DataFrame, since) -> DataFrame:
    """Sum of the falls between consecutive readings of an account; rises are top-ups."""
    w = W.partitionBy("account").orderBy("ts", "reading_id")
    fall = F.lag("balance").over(w) - F.col("balance")
    r = readings.where(F.col("ts") >= since).withColumn("fall", fall)
    return r.groupBy("account").agg(F.round(F.sum(F.greatest(F.coalesce("fall", F.lit(0.0)), F.lit(0.0))), 4).alias("spent"))
