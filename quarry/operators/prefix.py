"""Global prefix sums over a range-sorted table, from totals of its partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import broadcast_if_small, conf_set, discard, materialize

#: Partitions whose totals one window sums up.
BLOCK = 64
#: Rows of a group that one task's window may span; a larger group is scanned by ranges.
WINDOW_ROWS = 1_000_000
#: Rows for each range partition that the driver gets to choose the ranges by; a fifth of Spark's default.
SAMPLE = 20


def partition_count(df: DataFrame, times: int = 4) -> int:
    """Range partitions: several for each shuffle partition, so that hashing them leaves no task with much more than others."""
    return times * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def range_partitioned(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """``df`` with ``__part``, the number of a range of rows by group, order, content and a random salt, and what breaks ties.

    Neither a hot group nor many equal rows meet in one partition. The table is written to the shared folder, which makes salt
    and partition final: a lost executor cannot change them.
    """
    salted = df.withColumns({"__tie": F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), "__salt": F.rand(11)})
    keys = [F.col(c).asc_nulls_last() for c in by] + list(order) + [F.col("__tie"), F.col("__salt")]
    parts = partitions or partition_count(df)
    with conf_set(df.sparkSession, "spark.sql.execution.rangeExchange.sampleSizePerPartition", str(SAMPLE)):
        return materialize(salted.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()), "ranged")


def range_sorted(
    df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), partitions: int | None = None, out: str = "place", keep: Sequence[str] | None = None
) -> DataFrame:
    """``df`` with ``out``, a long that rises through each ``by`` group in ``order``: the number of a range times 2^33 plus the row's place in it.

    Ranges are those of :func:`range_partitioned`; the rows of a range are written sorted and numbered, so places are final and a group's rows in
    a range have consecutive ones. Only the columns ``keep`` are written, if they are given; the others break ties all the same.
    """
    salted = df.withColumns({"__tie": F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), "__salt": F.rand(11)})
    keys = [F.col(c).asc_nulls_last() for c in by] + list(order) + [F.col("__tie"), F.col("__salt")]
    with conf_set(df.sparkSession, "spark.sql.execution.rangeExchange.sampleSizePerPartition", str(SAMPLE)):
        ranged = salted.repartitionByRange(partitions or partition_count(df), *keys).sortWithinPartitions(*keys).drop("__tie", "__salt")
        kept = ranged.columns if keep is None else keep
        return materialize(ranged.select(*(F.col(f"`{c}`") for c in kept)).withColumn(out, F.monotonically_increasing_id()), "sorted")


def prefix_sums(df: DataFrame, value: str, order: Sequence[Column], by: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """``df`` with ``__before``, the sum of ``value`` in earlier rows, and ``__index``, their number, within each ``by`` group."""
    return sums_of_ranges(range_partitioned(df, order, by, partitions), value, order, by)


def sums_of_ranges(ranged: DataFrame, value: str, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """:func:`prefix_sums` of rows that were range-partitioned by the same order and groups.

    Only (partition, group) totals are summed up globally.
    """
    totals = ranged.groupBy("__part", *by).agg(F.sum(value).alias("__sum"), F.count("*").alias("__rows"))
    # one row for each partition and group that meet; a group of many partitions is summed up by blocks of them
    totals = materialize(totals.withColumn("__block", F.floor(F.col("__part") / BLOCK).cast("int")), "totals")
    blocks = totals.groupBy("__block", *by).agg(F.sum("__sum").alias("__sum"), F.sum("__rows").alias("__rows"))

    def earlier(keys: Sequence[str], order: str, name: str) -> Column:
        return F.coalesce(F.sum(name).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    before = blocks.select(
        *(F.col(c).alias(f"__by_{c}") for c in by), F.col("__block").alias("__of"), *(earlier(by, "__block", f"__{n}").alias(f"__{n}2") for n in ("sum", "rows"))
    )
    same = F.col("__block") == F.col("__of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    offsets = totals.join(before, same).select(
        *(F.col(c).alias(f"__by_{c}") for c in by),
        F.col("__part").alias("__of"),
        *((F.col(f"__{n}2") + earlier(["__block", *by], "__part", f"__{n}")).alias(f"__{n}0") for n in ("sum", "rows")),
    )
    within = Window.partitionBy("__part", *by).orderBy(*order, "__tie", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({"__sum1": F.coalesce(F.sum(value).over(within), F.lit(0)), "__rows1": F.count(F.lit(1)).over(within)})
    same = F.col("__part") == F.col("__of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    joined = local.join(broadcast_if_small(offsets), same)
    return joined.withColumns({"__before": F.col("__sum0") + F.col("__sum1"), "__index": F.col("__rows0") + F.col("__rows1")}).select(
        *(F.col(f"`{c}`") for c in ranged.columns if c not in ("__tie", "__salt", "__part")), "__before", "__index"
    )


@dataclass(frozen=True)
class Running:
    """A running value: the sum, count, max, min, or last non-null of a column, from a group's first row on, or from the last row on where ``since`` is true."""

    how: str
    column: str
    since: str | None = None


def _joined(how: str, before: Column, own: Column) -> Column:
    """The value of two stretches in a row from their values; each aggregate here is associative, and null where it has met nothing."""
    if how in ("sum", "count"):
        return F.coalesce(before + own, own, before)
    return F.coalesce(own, before) if how == "last" else {"max": F.greatest, "min": F.least}[how](before, own)


def _over(how: str, column: Column, window: Window) -> Column:
    return F.last(column, ignorenulls=True).over(window) if how == "last" else getattr(F, how)(column).over(window)


def scan(df: DataFrame, order: Sequence[Column], by: Sequence[str], values: Mapping[str, Running], partitions: int | None = None) -> DataFrame:
    """``df`` with running ``values`` over each ``by`` group's rows in ``order`` (ties by content), the row itself included.

    A group may be of any size: rows are sorted by ranges, each range is scanned by itself, and a range begins with what the group's earlier ranges
    come to. Those are a row for each range and group that meet; only the rows of groups that go beyond a range meet them. A true ``since``
    begins the value anew at its row; null counts as false. Column names that begin with ``__`` are the function's own.
    """
    placed = range_sorted(df, order, by, partitions, "__place").withColumn("__range", F.shiftright("__place", 33))
    resets = sorted({v.since for v in values.values() if v.since})
    own = {f"__since_{k}": F.coalesce(F.col(c), F.lit(False)).cast("long") for k, c in enumerate(resets)}
    within = Window.partitionBy("__range", *by)
    upto = within.orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    begun = {c: F.sum(c).over(upto) for c in own}
    local = placed.withColumns(own).withColumns(begun) if own else placed

    def stretch(v: Running) -> list[str]:
        return [f"__since_{resets.index(v.since)}"] if v.since else []

    def window(v: Running) -> Window:
        return Window.partitionBy("__range", *by, *stretch(v)).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)

    # written, as totals and rows are two readings
    local = materialize(local.withColumns({out: _over(v.how, F.col(v.column), window(v)) for out, v in values.items()}), "local")
    discard(placed)

    # what a range and group come to: the values of its last row
    kept = [*own, *values]
    totals = local.groupBy("__range", *by).agg(F.max_by(F.struct(*kept), "__place").alias("__end")).select("__range", *by, "__end.*")
    totals = materialize(totals, "totals")
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    several = totals.withColumn("__many", F.count("*").over(Window.partitionBy(*by))).where("__many > 1")
    # a range with a reset ends the stretches of those before it
    several = several.withColumns({f"{c}_all": F.sum(c).over(earlier.rowsBetween(Window.unboundedPreceding, 0)) for c in own})

    def carried(v: Running, out: str) -> Column:
        how = "sum" if v.how == "count" else v.how
        if not v.since:
            return _over(how, F.col(out), earlier)
        # the ranges since the last one with a reset, that one included, up to the range before
        marks = f"{stretch(v)[0]}_all"
        together = Window.partitionBy(*by, marks).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
        return _over(how, F.col(out), together)

    carry = several.withColumns({f"__carry_{out}": carried(v, out) for out, v in values.items()})
    # stretches with resets were summed up to their own range, so the range before has what is carried on
    carry = carry.withColumns({f"__carry_{out}": F.lag(f"__carry_{out}").over(Window.partitionBy(*by).orderBy("__range")) for out, v in values.items() if v.since})
    carry = carry.select(F.col("__range").alias("__of"), *(F.col(c).alias(f"__by_{k}") for k, c in enumerate(by)), *(f"__carry_{out}" for out in values))
    same = F.col("__range") == F.col("__of")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by_{k}"))
    met = local.join(broadcast_if_small(materialize(carry, "carry")), same, "left")

    def whole(v: Running, out: str) -> Column:
        joined = _joined(v.how, F.col(f"__carry_{out}"), F.col(out)).cast(local.schema[out].dataType)
        return F.when(F.col(stretch(v)[0]) == 0, joined).otherwise(F.col(out)) if v.since else joined

    return met.withColumns({out: whole(v, out) for out, v in values.items()}).select(*(F.col(f"`{c}`") for c in df.columns if c not in values), *values)


def heavy_groups(df: DataFrame, by: Sequence[str], most: int) -> DataFrame | None:
    """The groups of more than ``most`` rows, too large to be one task's; None if there are none. There are no more than rows over ``most``."""
    found = df.groupBy(*by).agg(F.count("*").alias("__rows")).where(F.col("__rows") > most).drop("__rows")
    return None if found.isEmpty() else materialize(found, "heavy")


def parted(df: DataFrame, by: Sequence[str], heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of other groups, and those of ``heavy`` ones."""
    named = broadcast_if_small(heavy.select(*(F.col(c).alias(f"__heavy_{k}") for k, c in enumerate(by))))
    same = F.lit(True)
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__heavy_{k}"))
    return df.join(named, same, "left_anti"), df.join(named, same, "left_semi")


def global_index(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), out: str = "idx", keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with each row's place, from 0 without gaps, in the total order (of its group).

    A row's place in its range is known from the sort, so rows only meet what comes before their range, by a join of a row for each range and group.
    ``keep``, with the columns of ``by`` among them, names the columns that come out.
    """
    placed = range_sorted(df, order, by, out="__place", keep=keep).withColumn("__range", F.shiftright("__place", 33))
    ranges = placed.groupBy("__range", *by).agg(F.min("__place").alias("__first"), F.count("*").alias("__rows"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first")
    offsets = materialize(ranges.select(F.col("__range").alias("__of"), *(F.col(c).alias(f"__by_{k}") for k, c in enumerate(by)), offset.alias("__offset")), "offsets")
    same = F.col("__range") == F.col("__of")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by_{k}"))
    joined = placed.join(broadcast_if_small(offsets), same).withColumn(out, F.col("__place") + F.col("__offset"))
    return joined.select(*(F.col(f"`{c}`") for c in (df.columns if keep is None else keep) if c != out), out)
