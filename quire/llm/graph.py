"""Connected components of an edge table, by alternating large and small stars.

A table of at most ``one_task`` edges, counted first, is left to one task. Otherwise each step sends a vertex's neighbours to the smallest of them, so edges never outgrow the input
and the label of a component is its smallest vertex. Steps are stored tables; only counts and a
checksum reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


ONE_TASK = 1 << 18


def _in_one_task(e: DataFrame) -> DataFrame:
    """Union-find over a table of checked size: iterating over it would cost more than it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                up[max(x, y)] = min(x, y)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])

    return e.coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, native: bool = False, one_task: int = ONE_TASK) -> DataFrame:
    """(a long, b long) -> (node, component) of every vertex that has an edge to another one;
    component is the smallest vertex reachable. No edges: no rows."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, seen = stored(e, "edges", small=True), None
    few = e.count() <= one_task
    if few and not native:
        return stored(_in_one_task(e), "components", small=True)
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b")).distinct()
        seen = state
        e = e.coalesce(1) if few else e
        both = e.union(e.select("b", "a"))
        both = both.coalesce(1) if few else both
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, F.col("a") == F.col("u"))
        e = stored(small.where("b <> m").select("b", "m").union(low).toDF("a", "b").distinct(), "edges", small=True)
