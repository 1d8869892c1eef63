"""The row-wise stages over streams, repeated deliveries dropped within a watermark, labels counted by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labelling import auto_label
from ..operators.preprocess import drop_empty, repeat_key, stages


def read_reviews(spark: SparkSession, path: str, schema_from: DataFrame, per_trigger: int = 64) -> DataFrame:
    """A stream of the Parquet files that path, possibly a pattern, names."""
    return spark.readStream.schema(schema_from.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def label_stream(stream: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    return auto_label(stream, text, keep)


def preprocess_stream(stream: DataFrame, text: str, time: str, keep: tuple[str, ...], delay: str = "30 days") -> DataFrame:
    """The stages of every row, without empty results and without repeats of a result within the watermark's delay."""
    done = drop_empty(stages(stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay), text, (*keep, time)))
    return done.withColumn("__key", repeat_key(F.col("stemming"))).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def windowed_labels(stream: DataFrame, text: str, time: str, window: str = "1 day", delay: str = "30 days") -> DataFrame:
    """start, sentiment, n: labels by time window; rows later than the delay after the newest are dropped by the state."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    labelled = auto_label(timed, text, (time,))
    counts = labelled.groupBy(F.window(time, window).alias("w"), "sentiment").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), "sentiment", "n")


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process all there is and stop; exactly once into Parquet files."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
