"""The same kernels on streams: files as they arrive, sessions with late events, duplicates within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions.sniff import container_kind, kind_of


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Files that arrive under a path, with their kind; give it to the functions of sources.documents."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    df = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(path)
    return df.select("path", "length", "modificationTime", "content", kind_of(F.col("content")).alias("kind"), container_kind(F.col("content")).alias("container"))


def sessions(events: DataFrame, time: str, by: list[str], gap: str, late: str | None = None) -> DataFrame:
    """Runs of events with no gap as long as `gap`, of a batch or a stream.

    late: how long events may come after newer ones (a watermark); a stream
    needs it to let go of finished sessions.
    """
    df = events.withColumn("_t", F.col(time).cast("timestamp"))
    df = df.withWatermark("_t", late) if late else df
    return (
        df.groupBy(*by, F.session_window("_t", gap).alias("_w"))
        .agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"))
        .drop("_w")
    )


def tumbling(events: DataFrame, time: str, by: list[str], width: str, value: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums by fixed or sliding windows."""
    df = events.withColumn("_t", F.col(time).cast("timestamp"))
    df = df.withWatermark("_t", late) if late else df
    w = F.window("_t", width, slide) if slide else F.window("_t", width)
    out = df.groupBy(*by, w.alias("_w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*by, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", "total")


def first_seen(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
