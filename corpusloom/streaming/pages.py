"""Streams: arriving pages are labelled once, latencies are reported by event time."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import dom


def page_stream(spark: SparkSession, path: str, schema: str = "page_id bigint, url string, html string", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def labelled(pages: DataFrame, at: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Lines with provenance of each page, once per page_id (within the watermark if pages carry a time)."""
    once = pages.withWatermark(at, delay).dropDuplicatesWithinWatermark(["page_id"]) if at else pages
    return dom.lines(once)


def timed(events: DataFrame) -> DataFrame:
    """Event times as instants: watermarks take no time without a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def latencies(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count, mean and maximum per window and type; late rows beyond the watermark are dropped by the engine."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = timed(events).withWatermark("ts", delay).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "mean", "most")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    out = timed(events).withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there, into Parquet, exactly once per checkpoint; gives what was written."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
