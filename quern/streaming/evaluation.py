"""Evaluation over a stream of logged results: windowed latency and counts with late data, and a per-batch sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(log: DataFrame, time: str = "ts", by: str = "event_type", value: str = "value", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, by, n, mean, high) of tumbling windows; rows later than the watermark don't count. Batch or stream."""
    rows = log.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if log.isStreaming else rows
    out = rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("high"))
    return out.select(F.col("w.start").alias("start"), by, "n", "mean", "high")


def flush_by(results: DataFrame, path: str, checkpoint: str, by: str = "event_type") -> StreamingQuery:
    """Write a stream's batches as they come, each batch to a folder of its own number, so that a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(by).parquet(f"{path}/batch={number}")

    return results.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
