"""Usage ledger, pricing and plan operators. Money and pages are integers throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pages_used(usage: DataFrame, start: Column) -> DataFrame:
    """Pages by user from ``start`` on, neither refunded nor paid with credits; no upper bound."""
    counted = (F.col("created_at") >= start) & ~F.col("refunded") & (F.col("kind") != "credits")
    return usage.groupBy("user_id").agg(F.coalesce(F.sum(F.when(counted, F.col("pages"))), F.lit(0)).cast("long").alias("pages_used"))


def free_offer_used(usage: DataFrame, month: Column) -> DataFrame:
    hit = usage.where((F.col("created_at") >= month) & F.col("kind").isin("free_offer", "legacy"))
    return hit.groupBy("user_id").agg(F.count("*").alias("n"))


def summary(users: DataFrame, used: DataFrame, plans: DataFrame) -> DataFrame:
    """Quota, use and rest of each user; a null quota is unlimited and leaves a null rest."""
    u = users.join(F.broadcast(plans), "plan", "left").join(used, "user_id", "left")
    n = F.coalesce("pages_used", F.lit(0)).cast("long")
    return u.select("user_id", "plan", F.col("monthly_pages").alias("quota"), n.alias("pages_used"), F.when(F.col("monthly_pages").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("monthly_pages") - n)).alias("remaining"))


def billable(pages: Column, unit: Column, least: Column) -> Column:
    """Pages charged: at least as many as reach the minimum payment."""
    return F.greatest(pages, F.ceil(least / unit)).cast("long")


def credit_once(notices: DataFrame) -> DataFrame:
    """The first successful notice of each payment credits; repeats do not."""
    w = W.partitionBy("payment_id").orderBy("at", "notice_id")
    return notices.where("ok").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def refund_ledger(usage: DataFrame) -> DataFrame:
    """Per user: pages handed back, and those of them that had been paid with credits."""
    r = usage.where("refunded")
    return r.groupBy("user_id").agg(F.sum("pages").alias("pages_back"), F.coalesce(F.sum(F.when(F.col("kind") == "credits", F.col("pages"))), F.lit(0)).cast("long").alias("credits_back"))
