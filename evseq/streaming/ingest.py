"""Incremental ingest of event shards: each run takes the files that are new since the last, then stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evseq import schema
from evseq.functions import codes


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema.EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(folder).dropna(subset=["subject_id", "time", "code"])


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Cleaned events, appended exactly once; the checkpoint remembers which files were read."""
    clean = event_stream(spark, folder).withColumns({"token": codes.sanitize("code", True), "type": codes.token_type(codes.sanitize("code", True))})
    return clean.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events of each type by hour; hours older than the delay are closed. Batch or streaming."""
    e = events.withColumn("time", F.col("time").cast("timestamp"))
    e = e.withWatermark("time", delay) if events.isStreaming else e
    return e.groupBy(F.window("time", "1 hour").alias("hour"), codes.token_type("code").alias("type")).agg(F.count(F.lit(1)).alias("n"))
