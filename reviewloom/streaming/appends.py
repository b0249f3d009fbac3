"""Normalized rows arriving as a stream: an extension of the batch engine.

Rows are told apart by key within a watermark, and response counts per project
are kept in windows over the loading time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.common import filled


def read(spark: SparkSession, folder: str, schema, per_trigger: int = 16) -> DataFrame:
    """Parquet files of normalized rows as they are written."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def arrivals(rows: DataFrame, late: str = "2 days", size: str = "1 day") -> DataFrame:
    """Rows and answered rows per project and day of loading, each key once, `late` rows dropped."""
    x = rows.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["rec_id"])
    answered = F.count(filled(F.col("response_text")))
    return x.groupBy(F.window("loaded_at", size).alias("w"), "project").agg(F.count("*").alias("n"), answered.alias("answered")).select(F.col("w.start").alias("day"), "project", "n", "answered")
