"""Pooling and patch counts over sample files as they arrive: both are sums, so each batch adds to the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.spatial import pool_spots


def pool_stream(points: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Write each batch's spot counts to its own folder, so that a batch that is run again replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        pool_spots(batch, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return points.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pooled(batches: DataFrame) -> DataFrame:
    """The sum over all batches so far."""
    return batches.groupBy("sample_id", "array_row", "array_col", "x", "y", "feature").agg(F.sum("value").alias("value"))


def count_stream(patches: DataFrame) -> DataFrame:
    """Running counts by sample, for a sink in complete or update mode."""
    return patches.groupBy("sample_id").agg(F.count("*").alias("num_patches"))
