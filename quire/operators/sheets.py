"""Spreadsheet operators over cells (sheet, r, c) and the ranges that a sheet declares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells within a merged range (r0, c0, r1, c1) of their sheet."""
    m = merges.withColumnRenamed("sheet", "of")
    return cells.join(m, (F.col("sheet") == F.col("of")) & F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1")), "left_semi")


def styled(cells: DataFrame, styles: DataFrame) -> DataFrame:
    """Cells with their style's columns; a cell whose index no style has takes style 0. The styles, a
    workbook's own table, are joined by index after one pass has set the wrong ones to 0."""
    known = styles.select(F.col("style").alias("known"))
    index = F.coalesce(F.col("known"), F.lit(0))
    return cells.join(known, F.col("style") == F.col("known"), "left").withColumn("style", index).drop("known").join(styles, "style")


def ready(cited: DataFrame) -> DataFrame:
    """Per sheet: the different strings that it cites, and whether all have a translation."""
    return cited.groupBy("sheet").agg(F.count_distinct("string_id").alias("strings"), F.bool_and("translated").alias("ready"))
