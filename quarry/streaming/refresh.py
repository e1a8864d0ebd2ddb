"""Incremental refresh: the batch operators over whatever the raw layer has got since the last run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def refresh(spark: SparkSession, raw_path: str, schema: str, state_path: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Pass new raw files to ``apply(batch, number)`` and stop; ``state_path`` remembers which files were seen.

    The code path is that of a full load. ``apply`` must be repeatable, as a batch that failed is passed again.
    """
    stream = spark.readStream.schema(schema).parquet(raw_path)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", state_path).trigger(availableNow=True).start()
