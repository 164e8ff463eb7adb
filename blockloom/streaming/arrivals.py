"""Incremental runs: a stream of city folders that are worked on as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def follow(spark: SparkSession, source: str, schema: StructType, make: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Work on files that are new under ``source`` since the last call, and end. Each batch's rows go to folders of
    their city and batch under ``out``: a batch that is done again replaces its own, and what a city got in earlier
    batches stays. Readers see the batch as the column ``batch``."""
    rows = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        made = make(batch).withColumn("batch", F.lit(number).cast("long"))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("city", "batch").parquet(out)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events a window and kind with their mean value, batch or stream; later ones than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(
        F.col("w.start").alias("start"), "event_type", "n", "mean_value"
    )
