"""The corpus operators' queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, line_dedup, media, mixing, packing, quality_rules, repeats, shingle_join, suffix_tree, warc

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: small Arrow batches bound what one batch can hold."""
    spark.conf.set(ARROW_ROWS, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op2_bwt_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.verdicts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("host").alias("source"), "host_rate")


def op6_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_equal").alias("n_equal_removed"), F.col("__n_near").alias("n_near_removed"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.with_media(table(spark, sf_dir, "documents")))


def op9_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.classes(table(spark, sf_dir, "documents"))


def op10_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_tree, op2_bwt_merge_dedup, op3_source_mix, op4_page_differencing, op5_host_rules, op6_line_edit_join, op7_warc_archive, op8_avi_mjpeg, op9_voronoi_join, op10_residual_packing)}


def oracle_sql() -> dict[str, str]:
    return {}
