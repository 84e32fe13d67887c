"""Click counts over a stream of log rows, with redelivered and late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEY = ["impression_id", "user_id", "impression_time"]


def read_log(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """Behaviours as a stream of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_clicks(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Distinct clicks of a stream; copies of a row that arrive within the watermark are dropped.

    Rows later than ``late`` behind the newest event time are dropped, as are rows without a time. State holds one
    key per row of the watermark's span, spread over the key's hash, so a hot user or article is spread as well.
    """
    rows = log.where("impression_time IS NOT NULL").withColumn("event_time", F.col("impression_time").cast("timestamp")).withWatermark("event_time", late)
    once = rows.dropDuplicatesWithinWatermark(KEY)
    ids = F.array_intersect("article_ids_clicked", "article_ids_inview")
    return once.select(*KEY, "event_time", F.explode(ids).alias("article_id")).where("article_id IS NOT NULL")


def windowed_counts(clicks: DataFrame, length: str = "1 day", slide: str | None = None) -> DataFrame:
    """(window_start, window_end, article_id, click_count) of tumbling or sliding windows over a stream of clicks."""
    span = F.window("event_time", length, slide) if slide else F.window("event_time", length)
    counted = clicks.groupBy(span.alias("w"), "article_id").agg(F.count("*").alias("click_count"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "article_id", "click_count")


def write_counts(counts: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None):
    """Appends finished windows as Parquet, exactly once; starts and returns the query."""
    writer = counts.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
