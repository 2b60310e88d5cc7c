"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
their input, so that any stage can be left out or run alone. Stages act on all rows: nothing is
sampled or capped. Null texts count as empty throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import line_dedup, mixing, packing, quality_rules, shingle_join
from quire.llm.common import fresh, stored
from quire.llm.queries import small_batches

#: SQL cannot express the stages' classes and packing; tests/llm hold them against brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame):
    """The rows with an id of their own, and what gives them back their columns. Ids that are null or
    repeat are replaced by row numbers, in a table written once, so that each row is decided by itself."""
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        return docs, lambda out: out.select(*docs.columns)
    (own,) = fresh(docs, "__doc")
    numbered = stored(docs.withColumnRenamed("doc_id", own).withColumn("doc_id", F.monotonically_increasing_id()), "rows")
    return numbered, lambda out: out.select(*[F.col(own).alias(c) if c == "doc_id" else F.col(f"`{c}`") for c in docs.columns])


def _decide(docs: DataFrame, operator, keep: str) -> DataFrame:
    """The rows that the operator's decision holds for."""
    keyed, back = _keyed(docs)
    return back(keyed.join(operator(keyed).where(keep).select("doc_id"), "doc_id", "left_semi"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the text rules and whose host does not fail as a whole."""
    small_batches(spark)
    return _decide(docs, quality_rules.verdicts, "kept")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies and near copies of lines go; a document that had words and has none left, its
    every line being in others, goes as a copy. n_chars follows the text."""
    small_batches(spark)
    out = line_dedup.dedup(docs)
    _, equal, near = out.columns[-3:]
    out = out.where((F.col(equal) + F.col(near) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest id (where ids are null or
    repeat, with the smallest row number)."""
    small_batches(spark)
    return _decide(docs, shingle_join.classes, "doc_id = component_id")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    small_batches(spark)
    keyed, back = _keyed(docs)
    times, copy = fresh(keyed, "__times", "__copy")
    taken = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("int")
    taken = stored(mixing.mix(keyed).select("doc_id", taken.alias(times)).where(F.col(times) > 0), "mix-taken")
    return back(keyed.join(taken, "doc_id").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("quality rules", rules), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("source mix", mix), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
