"""Cleaning and validation: required fields, types, periods, load completeness, load faults, outliers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The input, or ``ValueError`` if it lacks a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def drop_blank(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows whose required fields are neither null nor blank."""
    for c in required:
        df = df.where(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    return df


def normalise(df: DataFrame, dates: Mapping[str, str] | None = None, numbers: Mapping[str, str] | None = None) -> DataFrame:
    """Date columns parsed by their patterns and number columns cast to their types, thousands separators removed; null if invalid."""
    changes = {c: F.to_date(F.try_to_timestamp(F.trim(F.col(c)), F.lit(pattern))) for c, pattern in (dates or {}).items()}
    for c, kind in (numbers or {}).items():
        changes[c] = F.replace(F.trim(F.col(c)), F.lit(","), F.lit("")).try_cast(kind)
    return df.withColumns(changes)


def clean(df: DataFrame, required: Sequence[str], dates: Mapping[str, str], numbers: Mapping[str, str], period: tuple[str, date, date] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """The cleaning of collected files: columns checked, blanks dropped, types normalised, the period kept, columns tidied."""
    out = normalise(drop_blank(require_columns(df, [*required, *dates, *numbers]), required), dates, numbers)
    for c in [c for c in required if c in dates or c in numbers]:
        out = out.where(F.col(c).isNotNull())
    if period:
        out = out.where(F.col(period[0]).between(F.lit(period[1]), F.lit(period[2])))
    return out.select(*keep) if keep else out


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, nulls), in one pass."""
    counts = df.agg(F.count("*").alias("rows"), *(F.count(c).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col("rows"), (F.col("rows") - F.col(c)).alias("nulls")) for c in columns))
    return counts.select(F.inline(pairs))


def outliers(df: DataFrame, value: str, by: Sequence[str] = (), z: float = 3.0) -> DataFrame:
    """Rows further than ``z`` standard deviations from their group's mean, with ``zscore``."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__dev"))
    if by:
        joined = df.join(stats, list(by))
    else:
        mean, dev = stats.first()
        joined = df.withColumns({"__mean": F.lit(mean).cast("double"), "__dev": F.lit(dev).cast("double")})
    scored = joined.withColumn("zscore", (F.col(value) - F.col("__mean")) / F.nullif(F.col("__dev"), F.lit(0.0)))
    return scored.where(F.abs("zscore") > z).drop("__mean", "__dev")


def constant_loads(rows: DataFrame, batch: str, item: str, expected: DataFrame) -> DataFrame:
    """Batches whose item column holds one value throughout although the code table ``expected`` has more."""
    known = expected.select(item).distinct().count()
    loads = rows.groupBy(batch).agg(F.countDistinct(item).alias("items"), F.count("*").alias("rows"))
    return loads.where((F.col("items") == 1) & F.lit(known > 1))


def load_report(df: DataFrame, required: Sequence[str], day: str, first: date, last: date) -> DataFrame:
    """(check, passed, detail): rows present, columns present, dates valid, all within the period."""
    missing = [c for c in required if c not in df.columns]
    at = F.col(day).cast("date")
    facts = df.agg(
        F.count("*").alias("rows"),
        F.count_if(at.isNull()).alias("bad"),
        F.count_if(~at.between(F.lit(first), F.lit(last))).alias("outside"),
        F.max(at).cast("string").alias("newest"),
    )
    def line(name, passed, detail):
        return F.struct(F.lit(name).alias("check"), passed.alias("passed"), detail.cast("string").alias("detail"))

    return facts.select(
        F.inline(
            F.array(
                line("rows_present", F.col("rows") > 0, F.col("rows")),
                line("columns_present", F.lit(not missing), F.lit(",".join(missing))),
                line("dates_valid", F.col("bad") == 0, F.col("bad")),
                line("within_period", F.col("outside") == 0, F.col("outside")),
                line("newest_day", F.col("newest").isNotNull(), F.col("newest")),
            )
        )
    )


def is_newer(raw: DataFrame, source: DataFrame, day: str) -> bool:
    """Whether the source has a later day than the raw layer; an empty raw layer is older than any source."""
    newest = lambda df: df.agg(F.max(F.col(day).cast("date"))).first()[0]
    have, there = newest(raw), newest(source)
    return there is not None and (have is None or there > have)


def retrieval_report(results: DataFrame, k: int) -> DataFrame:
    """(check, passed, detail) for search results: no more than k for each query, ranks without gaps, similarities in order and in range."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy("rank")
    rows = results.withColumn("__rise", F.col("similarity") - F.lag("similarity").over(order) > 0)
    each = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("top"), F.bool_or("__rise").alias("rise"), F.max(F.abs("similarity")).alias("most"))
    facts = each.agg(F.max("n").alias("n"), F.bool_and(F.col("top") == F.col("n")).alias("dense"), F.bool_or("rise").alias("rise"), F.max("most").alias("most"))

    def line(name, passed, detail):
        return F.struct(F.lit(name).alias("check"), F.coalesce(passed, F.lit(True)).alias("passed"), detail.cast("string").alias("detail"))

    return facts.select(
        F.inline(
            F.array(
                line("at_most_k", F.col("n") <= k, F.col("n")),
                line("ranks_without_gap", F.col("dense"), F.col("dense")),
                line("similarity_falls", ~F.col("rise"), F.col("rise")),
                line("similarity_in_range", F.col("most") <= 1 + 1e-9, F.col("most") <= 1 + 1e-9),
            )
        )
    )
