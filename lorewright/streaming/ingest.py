"""Streaming ingestion of documents: chunk and append, each document once; windowed counts of late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lorewright.operators import chunks


def read_documents(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def chunk_stream(docs: DataFrame, key: str = "doc_id", at: str = "fetched_at", text: str = "text", path: str = "rel_path", delay: str = "77 days", size: int = 1200, overlap: int = 100) -> DataFrame:
    """Chunks of a stream of documents. A document that is delivered again within ``delay`` gives nothing; the watermark lets
    older keys leave the state."""
    once = docs.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
    return chunks.token_chunks(once.select(key, at, path, text), text, path, size, overlap)


def append(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once, from where its checkpoint left off."""
    w = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(window_start, kind, events): counts per tumbling window, final once the watermark has passed it."""
    w = events.withWatermark(at, delay).groupBy(F.window(at, width), kind).agg(F.count("*").alias("events"))
    return w.select(F.col("window.start").alias("window_start"), kind, "events")
