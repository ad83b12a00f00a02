"""Streams over a drop folder and over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corespar.sources.files import parse_files
from corespar.sources.store import append_new

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_folder(spark: SparkSession, drop: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parse files as they arrive in `drop` and append their elements to `target`; a file that comes again adds nothing."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(drop)

    def put(batch: DataFrame, _: int) -> None:
        append_new(parse_files(batch), target, ["source", "type", "content", "page"])

    writer = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def late_counts(elements: DataFrame, lateness: str = "30 days", window: str = "7 days") -> DataFrame:
    """Elements per source and week of arrival; rows later than the watermark are left out. For batch frames the watermark does nothing."""
    return elements.withWatermark("ingested_at", lateness).groupBy(F.window("ingested_at", window), "source").agg(F.count("*").alias("n"))
