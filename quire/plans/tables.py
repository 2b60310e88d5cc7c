"""Test tables as the library's inputs: deterministic derivations, the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "TIMESTAMP '1998-01-15 12:00:00'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    message = F.concat_ws(" ", "event_type", "props")
    source = F.element_at(F.array(*map(F.lit, ("frontend", "backend", "api"))), (F.col("event_id") % 3 + 1).cast("int"))
    status = F.when(F.col("user_id") % 2 == 0, "new").otherwise("handled")
    e = e.select("event_id", F.col("ts").alias("created_at"), "user_id", source.alias("source"), F.col("event_type").alias("level"), message.alias("message"), status.alias("status"), "props")
    head = F.substring(F.trim("message"), 1, 200)
    return e.withColumn("fingerprint", F.substring(F.sha2(F.concat_ws("|", "source", "level", F.lit(""), head), 256), 1, 32))


ERROR_LOG = """error_log AS (SELECT *, substr(sha256(source || '|' || level || '||' || substr(trim(message), 1, 200)), 1, 32) AS fingerprint FROM (
 SELECT event_id, ts AS created_at, user_id, CASE event_id % 3 WHEN 0 THEN 'frontend' WHEN 1 THEN 'backend' ELSE 'api' END AS source,
 event_type AS level, event_type || ' ' || props AS message, CASE WHEN user_id % 2 = 0 THEN 'new' ELSE 'handled' END AS status, props FROM events))"""
