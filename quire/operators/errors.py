"""Error-log operators: grouping by fingerprint, filters, guarded deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def error_groups(log: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One row per (fingerprint, source, level), last seen first; the limit is held to 1..200."""
    n_new = F.count_if(F.col("status") == "new")
    g = log.groupBy("fingerprint", "source", "level").agg(F.max("message").alias("message"), F.count("*").alias("occurrences"), n_new.alias("n_new"), F.max("created_at").alias("last_seen"), F.min("created_at").alias("first_seen"))
    g = g.withColumn("status", F.when(F.col("n_new") > 0, "new").otherwise("handled"))
    return g.orderBy(F.desc("last_seen"), "fingerprint").offset(max(0, offset)).limit(min(200, max(1, limit)))


def filtered(log: DataFrame, source: str | None = None, level: str | None = None, status: str | None = None, q: str | None = None) -> DataFrame:
    """Rows that meet all given filters; ``q`` is matched without case and its % and _ are wildcards."""
    for name, value in (("source", source), ("level", level), ("status", status)):
        if value is not None:
            log = log.where(F.col(name) == value)
    return log.where(F.col("message").ilike(f"%{q}%")) if q else log


def newest(log: DataFrame, limit: int) -> DataFrame:
    return log.orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)


def mark_handled(log: DataFrame, target) -> DataFrame:
    return log.withColumn("status", F.when(target & (F.col("status") == "new"), "handled").otherwise(F.col("status")))


def deletable(log: DataFrame) -> DataFrame:
    """Groups that may be deleted: none of their rows is still new."""
    g = log.groupBy("fingerprint").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "new").alias("open"))
    return g.where("open = 0").select("fingerprint", "n")
