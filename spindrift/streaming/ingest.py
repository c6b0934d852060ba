"""Streaming extension: page records and request logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindrift.functions.text import doc_length
from spindrift.operators.index import term_frequency
from spindrift.schema import PAGE_RECORD


def record_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """url, title, text, source, links, arrived of the records in files that appear in a folder."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_a_batch).schema("value string").text(folder)
    parsed = raw.select(F.from_json("value", PAGE_RECORD).alias("_r"), F.col("_metadata.file_modification_time").alias("arrived"))
    return parsed.where("_r.url is not null").select("_r.*", "arrived")


def first_of_url(records: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each URL once; its state is dropped when the watermark has passed, so it doesn't grow with the stream."""
    return records.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["url"])


def index_stream(records: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's pages and postings under its batch number; a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        pages = batch.select(
            F.xxhash64("url").alias("id"), "url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("content"), F.coalesce("source", F.lit("other")).alias("source")
        ).withColumn("length", doc_length(F.col("content")))
        pages.write.mode("overwrite").parquet(f"{out}/pages/batch={number}")
        term_frequency(batch.sparkSession.read.parquet(f"{out}/pages/batch={number}")).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")

    return records.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def windowed_requests(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """start, event_type, requests, mean_value of each tumbling window; works on batch and stream alike."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("requests"), F.avg("value").alias("mean_value")).select(
        F.col("w.start").alias("start"), "event_type", "requests", F.round("mean_value", 6).alias("mean_value")
    )
