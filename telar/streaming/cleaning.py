"""The stateless cleaners and keyed deduplication on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.operators.curators import clean_record
from telar.operators.quality import dirty_score


def clean_stream(spark: SparkSession, path: str, schema: str, curator: str = "regex", late: str = "1 hour", time: str = "loaded_at", key: str = "id", fmt: str = "json") -> DataFrame:
    """Records arriving as files: the first delivery of each key within ``late``, cleaned and scored."""
    rows = spark.readStream.schema(schema).format(fmt).load(path).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return clean_record(rows.withColumn("dirty_score", dirty_score(F.col("text"))), curator, ["text"])


def arrivals(stream: DataFrame, time: str = "loaded_at", window: str = "1 hour") -> DataFrame:
    """Records per source and window of arrival."""
    return stream.groupBy(F.window(time, window), "source").agg(F.count(F.lit(1)).alias("n"), F.sum("dirty_score").alias("dirt"))


def start(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = True):
    """Write a stream; with ``once`` everything there is, then stop."""
    writer = stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
