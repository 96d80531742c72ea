"""Parsing and expansion of streams: all of it treats each row by itself, so the batch code runs unchanged on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators import expand, views
from daybook.sources.wire import parse_documents


def read_files(spark: SparkSession, path: str, files_a_batch: int = 1000, strict: bool = False) -> DataFrame:
    """New files under path as they come, one document each."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_a_batch).schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return parse_documents(files.select(F.col("path").alias("doc_id"), "content"), "content", strict)


def events(documents: DataFrame) -> DataFrame:
    return views.events(documents)


def occurrences(documents: DataFrame, limit: int = expand.LIMIT) -> DataFrame:
    return expand.occurrences(views.events(documents), limit)


def events_by_day(documents: DataFrame, late: str = "31 days") -> DataFrame:
    """How many events start on each day (day, n): a day is counted once the watermark on starts has passed it."""
    starts = views.events(documents).select(F.col("start.wall").cast("timestamp").alias("at")).where("at IS NOT NULL").withWatermark("at", late)
    return starts.groupBy(F.window("at", "1 day").alias("day")).agg(F.count(F.lit(1)).alias("n")).select(F.col("day.start").cast("date").alias("day"), "n")
