"""Lines of many files with their number in their file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Rows as they are read, with file and place: ``path``, ``_block`` (where the part of the file that a task reads begins) and ``_at``."""
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), *(columns or ("value",)))


def numbered(rows: DataFrame, to: str = "line") -> DataFrame:
    """``placed`` rows with their number in their file, from 1: offsets come from the counts of the parts of a file, so no file is ordered in one task."""
    parts = rows.groupBy("path", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per part of a file
    starts = parts.select("path", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_start"))
    return rows.join(starts, ["path", "_block"]).withColumn(to, F.col("_at") + F.col("_start")).drop("_block", "_at", "_start")
