"""Streams of articles and scored rows. Watermarks bound the state; time zones follow the session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.scoring import indicator, monitor_label, risk_level


def event_stream(spark: SparkSession, folder: str, file_name: str, schema) -> DataFrame:
    """Parquet files of a folder as a stream with a zoned event time."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", file_name).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def with_end(stream: DataFrame, end: Column | str, folder: str, ts: str = "ts") -> DataFrame:
    """The stream and a last row at ``end``, all else null: behind every window's end and lateness it moves the
    watermark so far that what is still open is emitted. For sources that are finished."""
    spark = stream.sparkSession
    when = end if isinstance(end, Column) else F.lit(end).cast("timestamp")
    last = spark.range(1).select(*[when.alias(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema])
    last.write.parquet(f"{folder}/end")
    return stream.unionByName(spark.readStream.schema(last.schema).parquet(f"{folder}/end"))


def tone_monitor(stream: DataFrame, tone: str, key: str = "Symbol", ts: str = "ts", lookback: str = "24 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sliding mean tone and count per symbol, with label and indicator."""
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, lookback, step), key).agg(F.avg(tone).alias("average_sentiment"), F.count(tone).alias("article_count"))
    m = F.col("average_sentiment")
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "average_sentiment", "article_count",
                      monitor_label(m).alias("sentiment_label"), indicator(m).alias("risk_indicator"))


def deduplicated(stream: DataFrame, by: list[str], ts: str = "ts", late: str = "6 hours") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(by)


def alerts(stream: DataFrame, cuts: DataFrame, score: Column, key: str = "Symbol", default: float = 0.5) -> DataFrame:
    """Rows whose score reaches the symbol's threshold, with a five-level risk."""
    scored = stream.withColumn("risk_probability", score).join(cuts, key, "left")
    return scored.where(F.col("risk_probability") >= F.coalesce("threshold", F.lit(default))).withColumn("risk_level", risk_level(F.col("risk_probability")))


def warning_episodes(stream: DataFrame, warning: Column, key: str = "Symbol", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Consecutive warnings merged while the gap stays short. All rows move the watermark, not warnings alone."""
    # a filter that names the event time stays behind the watermark
    out = stream.withWatermark(ts, late).where(F.when(F.col(ts).isNotNull(), warning)).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("warnings"))
    return out.select(F.col("session_window.start").alias("episode_start"), F.col("session_window.end").alias("episode_end"), key, "warnings")


def run_to_files(df: DataFrame, folder: str) -> StreamingQuery:
    """Process what is available and append it to parquet; restarts continue from the checkpoint."""
    return df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()


def run_batches(df: DataFrame, folder: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return df.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
