"""Layered marts: code lookups, pivots, date spines, grain roll-ups, schema-driven joins and refresh."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.runtime import broadcast_if_small

#: Distinct pivot keys that become columns, at most.
MOST_COLUMNS = 2_000


def code_lookup(facts: DataFrame, codes: DataFrame, key: str, code: str = "code", name: str = "name", out: str | None = None) -> DataFrame:
    """Facts with the name of their code; facts without one are kept with null. Only a code table of checked size is broadcast."""
    names = codes.select(F.col(code).alias("__code"), F.col(name).alias(out or f"{key}_name"))
    return facts.join(broadcast_if_small(names), F.col(key) == F.col("__code"), "left").drop("__code")


def composite_key(*parts: str, separator: str = "_") -> Column:
    """One pivot key from several columns; nulls are left out."""
    return F.concat_ws(separator, *parts)


def pivot_static(df: DataFrame, keys: Sequence[str], key: Column, values: Sequence[str], value: str, suffix: str = "") -> DataFrame:
    """One column for each listed pivot value, with the maximum of ``value``; names get the suffix."""
    cells = [F.max(F.when(key == v, F.col(value))).alias(f"{v}{suffix}") for v in values]
    return df.groupBy(*keys).agg(*cells)


def pivot_values(df: DataFrame, key: Column, most: int = MOST_COLUMNS) -> list[str]:
    """The distinct pivot keys in order. They become columns, so more than ``most`` of them are an error."""
    rows = df.select(key.cast("string").alias("k")).where("k is not null").distinct().orderBy("k").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} pivot columns")
    return [r["k"] for r in rows]


def dynamic_pivot(df: DataFrame, keys: Sequence[str], key: Column, value: str, suffix: str = "") -> DataFrame:
    """:func:`pivot_static` over the values that the data hold."""
    return pivot_static(df, keys, key.cast("string"), pivot_values(df, key), value, suffix)


def unpivot(wide: DataFrame, keys: Sequence[str], suffix: str = "") -> DataFrame:
    """(keys, pivot_key, value) of the non-null cells of a pivot; the columns come from the table's schema."""
    cells = [c for c in wide.columns if c not in keys]
    stacked = wide.select(*keys, *(F.col(f"`{c}`").cast("double").alias(c) for c in cells)).unpivot(list(keys), cells, "pivot_key", "value")
    named = F.col("pivot_key") if not suffix else F.expr(f"substring(pivot_key, 1, length(pivot_key) - {len(suffix)})")
    return stacked.where("value is not null").withColumn("pivot_key", named)


def date_spine(tables: Mapping[str, DataFrame], on: str = "ymd", extra: Sequence[str] = ()) -> DataFrame:
    """All dates of all tables, with each table's other columns as ``<table>_<column>``, null where it lacks the date.

    The columns are discovered from the tables' schemas. Each table has one row for each key.
    """
    keys = [on, *extra]
    spine = reduce(DataFrame.union, (t.select(*keys) for t in tables.values())).distinct()

    def add(left: DataFrame, item: tuple[str, DataFrame]) -> DataFrame:
        name, right = item
        renamed = right.select(*keys, *(F.col(f"`{c}`").alias(f"{name}_{c}") for c in right.columns if c not in keys))
        return left.join(renamed, keys, "left")

    return reduce(add, tables.items(), spine)


GRAINS = {"daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}


def at_grain(df: DataFrame, grain: str, on: str, measures: Mapping[str, str]) -> DataFrame:
    """(ymd, measures): the maximum, sum, ... of each measure by day, ISO week, month or year."""
    day = F.trunc(F.col(on).cast("date"), GRAINS[grain]) if grain != "daily" else F.col(on).cast("date")
    return df.groupBy(day.alias("ymd")).agg(*(getattr(F, how)(c).alias(c) for c, how in measures.items()))


def overall(tables: Mapping[str, DataFrame], grain: str, measures: Mapping[str, Mapping[str, str]], on: Mapping[str, str]) -> DataFrame:
    """The overall mart at a grain: every table rolled up, then joined to the union of their dates."""
    return date_spine({n: at_grain(t, grain, on[n], measures[n]) for n, t in tables.items()})


def normal_year(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Monthly sums beside ``normal_value``, the mean of the same month in the other years that have it."""
    at = F.col(day).cast("date")
    monthly = df.groupBy(*keys, F.year(at).alias("year"), F.month(at).alias("month")).agg(F.sum(value).alias("value"))
    months = monthly.groupBy(*keys, "month").agg(F.sum("value").alias("__all"), F.count("value").alias("__years"))
    joined = monthly.join(months, [*keys, "month"], "left")
    others = (F.col("__all") - F.col("value")).cast("double") / F.nullif(F.col("__years") - 1, F.lit(0))
    return joined.withColumn("normal_value", others).drop("__all", "__years")


def with_normal(current: DataFrame, normal: DataFrame, keys: Sequence[str], value: str = "price") -> DataFrame:
    """Current rows with the loaded normal-year value of the same keys, or null."""
    return current.join(normal.select(*keys, F.col(value).alias(f"normal_{value}")), list(keys), "left")


# ---- periods -----------------------------------------------------------------------------------------------------------


def month_window(reference: date, months_back: int = 1) -> tuple[date, date]:
    """First and last day of the month that lies ``months_back`` before the reference date's."""
    month = reference.year * 12 + reference.month - 1 - months_back
    first = date(month // 12, month % 12 + 1, 1)
    following = date((month + 1) // 12, (month + 1) % 12 + 1, 1)
    return first, following - timedelta(days=1)


def in_period(df: DataFrame, day: str, first: date | str, last: date | str) -> DataFrame:
    """Rows from the first to the last day, both included. The bounds are on the column itself, so that a scan can skip row groups."""
    column = F.col(day)
    until = F.lit(str(last)).cast("date")
    return df.where((column >= F.lit(str(first)).cast("date")) & (column < F.date_add(until, 1)))


def month_ends(day: Column) -> dict[str, Column]:
    """A date's month end, the date a month before (month ends clamped), and its ``yyyyMMdd`` key."""
    at = day.cast("date")
    return {"month_end": F.last_day(at), "month_before": F.add_months(at, -1), "ymd": F.date_format(at, "yyyyMMdd")}
