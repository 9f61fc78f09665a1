"""Records that arrive in batches: append each to the collection and refresh what depends on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_and_refresh(stream: DataFrame, target: str, refresh: Callable[[DataFrame], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends each micro-batch to the Parquet table ``target`` and calls ``refresh`` with the whole of it.

    A batch is written to a partition of its own number, so that a repeated batch replaces itself.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        refresh(spark.read.parquet(target).drop("batch"))

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Arrivals per window and key, late ones up to a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
