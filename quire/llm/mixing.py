"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets whole copies of itself as often as its target holds them; what remains of the
budget is fitted on the histogram of exact document lengths. A proportional quota per length
carries its rounding error on to the next length, and a bounded-knapsack dynamic programme (bit
sets over sums) fits what is then left over. Documents of a length are chosen by a seeded hash.

Only counts by (source, length) reach the fitting step, at most one row for each distinct length,
however many documents a source has. Quotas become documents through counts by hash bucket, so no
task ever holds all documents of a source or of a length.

Defined cases: a null text has size 0; the null source is a source of its own, last in order;
repeated rows are separate documents; documents of size 0 are taken 0 words; an empty table
returns no row; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored

WEIGHTS = (3, 1, 2)
BUCKETS = 1024


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same and target: ``share`` of all sizes dealt by weight, no
    source above ``most`` times its size, the excess dealt again by weight.

    Filling sources in order of size per weight reaches the same targets as dealing the excess
    again and again: the first source that its level would not fill sets the level of the rest.
    One row per source goes through the two windows."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    t = totals.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    t = t.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("rest_w", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
    budget = share * F.sum("source_size").over(W.partitionBy())
    t = t.withColumn("level", (budget - F.col("before")) / F.col("rest_w"))
    open_ = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(W.partitionBy())
    return t.withColumn("open", open_["level"]).select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * F.col("open"), F.col("cap"))).alias("target"))


def fit(lengths: list[int], counts: list[int], budget: int, slack: int = 1 << 16) -> list[int]:
    """How many documents of each length to take, at most ``counts``, so that the words come as
    near ``budget`` as the final programme over at most ``slack`` words can bring them."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    order = sorted((i for i, n in enumerate(lengths) if n > 0), key=lambda i: -lengths[i])
    aim = max(0, budget - slack)
    taken, got, due = [0] * len(lengths), 0, 0.0
    for i in order:
        due += lengths[i] * counts[i] * aim / total
        taken[i] = max(0, min(counts[i], int((due - got) // lengths[i])))
        got += taken[i] * lengths[i]
    left = budget - got
    # bounded knapsack: counts split in powers of two, one bit set of reachable sums per item
    over = left + lengths[order[0]]  # a sum past the budget may be nearer to it
    mask, sums, items = (1 << (over + 1)) - 1, 1, []
    for i in order:
        free, k = min(counts[i] - taken[i], over // lengths[i]), 1
        while free > 0:
            k = min(k, free)
            new = (sums | (sums << (k * lengths[i]))) & mask
            if new != sums:
                items.append((i, k, sums))
                sums = new
            free -= k
            k *= 2
        if sums >> left & 1:
            break
    below = (sums & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = sums >> (left + 1)
    above = left + 1 + (above & -above).bit_length() - 1 if above else over + left + 1
    at = below if left - below <= above - left else above
    for i, k, before in reversed(items):
        if not before >> at & 1:
            taken[i] += k
            at -= k * lengths[i]
    return taken


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20, **how) -> DataFrame:
    """doc_id, size, source, source_size, target, taken (words the mix takes, repeats counted)."""
    spark = docs.sparkSession
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    h = F.xxhash64(F.lit(seed), "doc_id")
    sizes = stored(sizes.withColumn("h", h).withColumn("bucket", F.pmod(F.col("h"), F.lit(BUCKETS))), "mix-sizes")
    by_bucket = stored(sizes.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")), "mix-counts", small=True)
    lengths = by_bucket.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goal = stored(targets(by_bucket.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), **how), "mix-targets", small=True)

    def quota(pdf: pd.DataFrame) -> pd.DataFrame:
        total, target = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
        copies = int(target // total) if total else 0
        pdf["copies"] = copies
        pdf["quota"] = fit(pdf["size"].tolist(), pdf["n"].tolist(), round(target - copies * total)) if total else 0
        return pdf[["source", "size", "copies", "quota"]]

    key = F.col("source").eqNullSafe(F.col("s"))
    goal_s = goal.withColumnRenamed("source", "s")
    quotas = lengths.join(F.broadcast(goal_s) if goal.count() <= 100_000 else goal_s, key).drop("s").groupBy("source").applyInPandas(quota, "source string, size long, copies long, quota long")
    # buckets wholly below a length's quota are taken; ranks are needed in one bucket only
    per = W.partitionBy("source", "size").orderBy("bucket")
    q = quotas.select(F.col("source").alias("s"), F.col("size").alias("z"), "copies", "quota")
    cut = by_bucket.withColumn("before", F.sum("n").over(per) - F.col("n")).join(q, key & (F.col("size") == F.col("z"))).drop("s", "z")
    cut = stored(cut.withColumn("room", F.least(F.greatest(F.col("quota") - F.col("before"), F.lit(0)), F.col("n"))).select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("b"), "copies", "room", "n"), "mix-cut", small=True)
    out = sizes.join(cut, key & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b")))
    whole = out.where("room = 0 or room = n").withColumn("extra", (F.col("room") > 0).cast("long"))
    edge = out.where("room > 0 and room < n").withColumn("extra", (F.row_number().over(W.partitionBy("s", "z", "b").orderBy("h", "doc_id")) <= F.col("room")).cast("long"))
    out = whole.unionByName(edge).drop("s", "z")
    out = out.join(F.broadcast(goal_s) if goal.count() <= 100_000 else goal_s, key)
    return out.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * (F.col("copies") + F.col("extra"))).alias("taken"))
