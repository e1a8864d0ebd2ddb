"""Exact quantiles of groups by distributed selection, and fences of quartiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import broadcast_if_small, discard, materialize

#: Ranges that an open interval is cut into in each round.
RANGES = 1024
#: Rows of an interval that are few enough to be put in order.
FEW = 10_000
#: Rounds after which an interval is put in order in any case; doubles leave no more than some hundred.
MOST_ROUNDS = 120


def _same(by: Sequence[str]) -> Column:
    out = F.lit(True)
    for k, c in enumerate(by):
        out &= F.col(c).eqNullSafe(F.col(f"__by_{k}"))
    return out


def _range(x: Column, low: Column, high: Column) -> Column:
    """The number of a value's range in an interval: rises with the value, whatever is rounded; infinite values have ranges of their own."""
    width = high / 2 - low / 2
    within = F.when(width > 0, F.least(F.lit(RANGES - 1), F.floor((x / 2 - low / 2) / width * RANGES))).otherwise(F.lit(0))
    return F.when(low.isNull() | (x < low), F.when(x < 0, -1).otherwise(RANGES)).when(x > high, RANGES).otherwise(within).cast("int")


def exact_quantiles(df: DataFrame, value: str, quantiles: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, q, n, quantile): of each group's n values, the first one, in order, that q * n of them do not exceed (SQL's percentile_disc).

    Values are compared as doubles; nulls and NaNs do not count, and a group without others gives no rows. An interval that holds a quantile is cut
    into ranges, whose rows are counted by partial aggregates; the range in which the wanted rank falls is the next interval, until its least and
    greatest value are equal or few rows are left. The rows are read three times, those of the first ranges that hold a quantile are written, and no
    group is ever sorted or gathered.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    finite = F.when(F.abs("x") < F.lit(float("inf")), F.col("x"))
    start = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high"))
    listed = F.array(*(F.lit(float(q)) for q in quantiles))
    rank = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("q"))).cast("long")
    named = [F.col(c).alias(f"__by_{k}") for k, c in enumerate(by)]
    keys = [f"__by_{k}" for k in range(len(by))]
    goals = start.select(*named, "n", "low", "high", F.explode(listed).alias("q")).withColumn("rank", rank)
    # only groups with rows: without groups, an aggregate has a row even if there are none
    goals = materialize(goals.where("n > 0"), "goals")
    found: DataFrame | None = None
    for turn in range(MOST_ROUNDS):
        met = rows.join(broadcast_if_small(goals), _same(by) & (F.col("of") == F.col("q")) if turn else _same(by))
        counted = met.groupBy(*keys, "q", "n", "rank", _range(F.col("x"), F.col("low"), F.col("high")).alias("r")).agg(F.count("*").alias("c"), F.min("x").alias("a"), F.max("x").alias("z"))
        upto = Window.partitionBy(*keys, "q").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
        placed = counted.withColumn("through", F.sum("c").over(upto)).where((F.col("through") >= F.col("rank")) & (F.col("through") - F.col("c") < F.col("rank")))
        picked = placed.select(*keys, "q", "n", (F.col("rank") - (F.col("through") - F.col("c"))).alias("rank"), F.col("a").alias("low"), F.col("z").alias("high"), "c")
        picked = materialize(picked, "picked")
        closed = picked.where("low = high").select(*keys, "q", "n", F.col("low").alias("quantile"))
        found = closed if found is None else found.unionByName(closed)
        goals = picked.where("low < high")
        most = goals.agg(F.max("c")).first()[0]
        if most is None:
            break
        # rows of the next intervals, each under the quantile that wants them
        wanted = broadcast_if_small(goals.select(*keys, F.col("q").alias("of"), "low", "high"))
        source = rows if turn == 0 else rows.withColumnRenamed("of", "was")
        condition = _same(by) & F.col("x").between(F.col("low"), F.col("high"))
        if turn:
            condition &= F.col("was") == F.col("of")
        kept = materialize(source.join(wanted, condition).select(*by, "x", "of"), "kept")
        if turn:
            discard(rows)
        rows = kept
        if most <= FEW:
            break
    if most is not None:
        # equal values are one row; few are left for each quantile
        each = rows.groupBy(*by, "of", "x").agg(F.count("*").alias("c"))
        upto = Window.partitionBy(*by, "of").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        summed = each.withColumn("through", F.sum("c").over(upto))
        ends = summed.join(broadcast_if_small(goals), _same(by) & (F.col("of") == F.col("q"))).where((F.col("through") >= F.col("rank")) & (F.col("through") - summed["c"] < F.col("rank")))
        found = found.unionByName(ends.select(*keys, "q", "n", F.col("x").alias("quantile")))
    return found.select(*(F.col(f"__by_{k}").alias(c) for k, c in enumerate(by)), "q", "n", "quantile")


def fences(df: DataFrame, value: str, by: Sequence[str] = (), factor: float = 1.5) -> DataFrame:
    """(by, q1, q3, low, high): each group's exact quartiles, and ``factor`` times their distance beyond them."""
    quartiles = exact_quantiles(df, value, (0.25, 0.75), by)
    both = quartiles.groupBy(*by).agg(F.max(F.when(F.col("q") == 0.25, F.col("quantile"))).alias("q1"), F.max(F.when(F.col("q") == 0.75, F.col("quantile"))).alias("q3"))
    both = both.where("q1 is not null")
    reach = factor * (F.col("q3") - F.col("q1"))
    return both.withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach})


def beyond_fences(df: DataFrame, value: str, by: Sequence[str] = (), factor: float = 1.5) -> DataFrame:
    """The rows whose value lies outside of its group's fences, with ``low`` and ``high``. Unlike a z-score's, the limits do not move with the outliers."""
    limits = fences(df, value, by, factor).select(*(F.col(c).alias(f"__by_{k}") for k, c in enumerate(by)), "low", "high")
    x = F.col(value).cast("double")
    return df.join(broadcast_if_small(materialize(limits, "fences")), _same(by)).where((x < F.col("low")) | (x > F.col("high"))).select(*(f"`{c}`" for c in df.columns), "low", "high")
