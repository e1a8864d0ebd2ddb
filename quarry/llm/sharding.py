"""Contiguous shards of near-equal byte size, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import names_apart
from quarry.operators.prefix import range_partitioned, sums_of_ranges


def byte_size(text: Column, extra: int = 8) -> Column:
    """UTF-8 bytes of the text, none for null, plus a record's fixed overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + extra).cast("long")


@names_apart
def shard_by_bytes(docs: DataFrame, size: str = "size", shards: int = 24, order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``docs`` with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Rows are range-sorted by ``order`` (nulls last, ties by size, then content); global prefix sums of ``size`` come from partition
    totals. A row's shard is the equal slice of all bytes in which its middle byte lies: shards are contiguous in
    the order, and a boundary misses its target by half a row at most. Equal rows are interchangeable. ``size`` is positive;
    a single row larger than a slice leaves shards empty. Input columns named like the added ones are replaced. No rows give
    no rows.
    """
    keys = [F.col(c).asc_nulls_last() for c in order] + [F.col(size)]
    ranged = range_partitioned(docs.drop("shard", "slot"), keys)
    summed = sums_of_ranges(ranged, size, keys)
    total = ranged.agg(F.sum(size)).first()[0] or 1
    middle = (F.col("__before") * 2 + F.col(size)).cast("decimal(30,0)")
    shard = F.least(F.lit(shards - 1), F.expr("__middle div CAST(%d AS DECIMAL(38,0))" % (2 * total))).cast("int")
    placed = summed.withColumn("__middle", middle * F.lit(shards)).withColumn("shard", shard)
    # at most one row for each shard
    first = placed.groupBy(F.col("shard").alias("__shard")).agg(F.min("__index").alias("__first"))
    joined = placed.join(F.broadcast(first), F.col("shard") == F.col("__shard"))
    return joined.withColumn("slot", (F.col("__index") - F.col("__first")).cast("long")).drop("__before", "__index", "__middle", "__shard", "__first")
