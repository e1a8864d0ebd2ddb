"""Marts that grow with their loads: a load touches some dates, and only what depends on these is computed anew.

Raw rows of a load are kept as they came, and reduced once to a delta: partial aggregates for each date and pivot key, which can be merged in
any order. A ledger has a row for each load that is complete, so a load that comes twice changes nothing, one that broke off is written over
by its repetition, and readers see no part of it. A mart at a grain is the date spine of all feeds' pivots. To refresh it, the dates of loads
that it does not hold yet give the touched periods; their rows are merged from the deltas, rows of other periods in the same bucket are kept,
and the bucket is replaced. A correction is a load that takes an earlier one's place: periods that either of them touches are computed anew, so
maxima fall where they have to. Raw rows are never read again.

One writer at a time is assumed for a mart, as a scheduled job is; readers need no care.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.mart import GRAINS, composite_key, date_spine, pivot_values
from quarry.runtime import broadcast_if_small, discard, materialize
from quarry.streaming.refresh import refresh as follow_files

#: How partial results of an aggregate are merged.
MERGED = {"sum": "sum", "count": "sum", "max": "max", "min": "min"}
#: Where a mart's rows lie: a folder for each year, of a row for each period, and one for rows without a date.
NO_DATE = "none"
LEDGER = "feed string, batch long, version long, event string, rows long, newest date"


@dataclass(frozen=True)
class Feed:
    """A raw table: its date column, measures as {name: (sum, count, max or min, column)}, and the columns of its pivot key, if any."""

    day: str
    measures: Mapping[str, tuple[str, str]]
    key: Sequence[str] = ()
    suffix: str = ""


def _bucket() -> Column:
    return F.coalesce(F.date_format("ymd", "yyyy"), F.lit(NO_DATE))


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    files, place = _hadoop(spark, path)
    return files.exists(place)


def _delete(spark: SparkSession, path: str) -> None:
    files, place = _hadoop(spark, path)
    files.delete(place, True)


class GrowingMart:
    """Overall marts at several grains over the loads of several feeds, under one root in the layers raw, pivot and overall."""

    def __init__(self, spark: SparkSession, root: str, feeds: Mapping[str, Feed], grains: Sequence[str] = tuple(GRAINS)):
        for name, feed in feeds.items():
            if odd := {how for how, _ in feed.measures.values()} - set(MERGED):
                raise ValueError(f"{name}: partial results of {', '.join(sorted(odd))} cannot be merged")
        self.spark, self.root, self.feeds, self.grains = spark, root.rstrip("/"), dict(feeds), tuple(grains)

    # ---- ledger ---------------------------------------------------------------------------------------------------------

    def ledger(self) -> DataFrame:
        """(feed, batch, version, event, rows, newest): a row for each complete load, and one for each that the marts hold."""
        path = f"{self.root}/ledger"
        return self.spark.read.schema(LEDGER).parquet(path) if _exists(self.spark, path) else self.spark.createDataFrame([], LEDGER)

    def _note(self, rows: list[tuple]) -> None:
        """Rows are committed together, as they are one file."""
        names = [c.split()[0] for c in LEDGER.split(", ")]
        noted = F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(names, row, strict=True))) for row in rows))
        one = self.spark.range(0, 1, 1, 1).select(F.inline(noted)).to(T.StructType.fromDDL(LEDGER))
        one.write.mode("append").parquet(f"{self.root}/ledger")

    def _versions(self) -> tuple[dict[tuple[str, int], int], dict[tuple[str, int], int]]:
        """The latest loaded and applied version of each load; the driver gets a row for each of them."""
        latest = self.ledger().groupBy("feed", "batch", "event").agg(F.max("version").alias("version")).collect()
        return tuple({(r["feed"], r["batch"]): r["version"] for r in latest if r["event"] == event} for event in ("loaded", "applied"))

    def newest(self, feed: str):
        """The last date among a feed's loads, or None; corrected loads count as they are now."""
        rows = self.ledger().where((F.col("feed") == feed) & (F.col("event") == "loaded"))
        return rows.groupBy("batch").agg(F.max_by("newest", "version").alias("newest")).agg(F.max("newest")).first()[0]

    def only_newer(self, feed: str, rows: DataFrame) -> DataFrame:
        """The rows that a collection still has to load: those after the newest date that is there; all, if there is none."""
        newest = self.newest(feed)
        return rows if newest is None else rows.where(F.col(self.feeds[feed].day).cast("date") > F.lit(newest))

    # ---- loads ----------------------------------------------------------------------------------------------------------

    def _place(self, layer: str, feed: str, batch: int, version: int) -> str:
        return f"{self.root}/{layer}/{feed}/batch={batch}/version={version}"

    def load(self, feed: str, batch: int, rows: DataFrame, correct: bool = False) -> bool:
        """Take in a load; False, and nothing is changed, if the ledger has its number already.

        With ``correct``, the rows take the place of the load of that number, whose own stay in the raw layer as an earlier version. Rows without a
        date make up a period of their own. A load may be empty. Marts show it after :meth:`refresh`.
        """
        spec = self.feeds[feed]
        known = self._versions()[0].get((feed, batch), 0)
        if known and not correct:
            return False
        version = known + 1
        raw = self._place("raw", feed, batch, version)
        rows.write.mode("overwrite").parquet(raw)
        kept = self.spark.read.schema(rows.schema).parquet(raw)
        key = composite_key(*spec.key) if spec.key else F.lit(None).cast("string")
        partial = [getattr(F, how)(column).alias(name) for name, (how, column) in spec.measures.items()]
        delta = kept.groupBy(F.col(spec.day).cast("date").alias("ymd"), key.alias("pivot_key")).agg(*partial, F.count("*").alias("raw_rows"))
        place = self._place("pivot", feed, batch, version)
        # sorted, so that scans for a few dates skip the rest
        delta.sort("ymd").write.mode("overwrite").parquet(place)
        total = self.spark.read.schema(delta.schema).parquet(place).agg(F.sum("raw_rows"), F.max("ymd")).first()
        self._note([(feed, batch, version, "loaded", total[0] or 0, total[1])])
        return True

    def _deltas(self, feed: str, versions: Sequence[tuple[int, int]]) -> DataFrame | None:
        """The deltas of these (batch, version) of a feed."""
        places = [self._place("pivot", feed, *v) for v in versions]
        return self.spark.read.parquet(*places) if places else None

    # ---- marts ----------------------------------------------------------------------------------------------------------

    def refresh(self) -> dict[str, int]:
        """Bring all marts up to the ledger; the number of periods that were computed anew at each grain, empty if there was nothing to do.

        A refresh that broke off is done again in whole, with the same result.
        """
        loaded, applied = self._versions()
        pending = {k: v for k, v in loaded.items() if v > applied.get(k, 0)}
        if not pending:
            return {}
        changed = [self._deltas(f, [(b, v) for (feed, b), last in pending.items() if feed == f for v in range(max(1, applied.get((f, b), 0)), last + 1)]) for f in self.feeds]
        days = materialize(reduce(DataFrame.union, (d.select("ymd") for d in changed if d is not None)).distinct(), "touched")
        now = {f: self._deltas(f, [(b, v) for (feed, b), v in sorted(loaded.items()) if feed == f]) for f in self.feeds}
        keys = {f: pivot_values(d, F.col("pivot_key")) for f, d in now.items() if d is not None and self.feeds[f].key}
        done = {grain: self._replace(grain, days, now, keys) for grain in self.grains}
        discard(days)
        self._note([(feed, batch, version, "applied", None, None) for (feed, batch), version in sorted(pending.items())])
        return done

    def _period(self, grain: str) -> Column:
        return F.col("ymd") if grain == "daily" else F.trunc("ymd", GRAINS[grain])

    def _wide(self, feed: str, merged: DataFrame, keys: Sequence[str] | None) -> DataFrame:
        """A row for each period, with a column for each pivot key and measure, or for each measure of a feed without a pivot."""
        spec = self.feeds[feed]
        if keys is None:
            return merged.drop("pivot_key")
        several = len(spec.measures) > 1
        cells = [F.max(F.when(F.col("pivot_key") == k, F.col(m))).alias(f"{k}_{m}" if several else f"{k}{spec.suffix}") for k in keys for m in spec.measures]
        return merged.groupBy("ymd").agg(*cells) if cells else merged.select("ymd").distinct()

    def _replace(self, grain: str, days: DataFrame, now: Mapping[str, DataFrame | None], keys: Mapping[str, list[str]]) -> int:
        """Compute the touched periods of a grain anew and put them in their buckets' place."""
        periods = materialize(days.select(self._period(grain).alias("period")).distinct(), "periods")
        count, low, high = periods.agg(F.count("*"), F.min("period"), F.max("period")).first()
        touched = broadcast_if_small(periods)
        tables = {}
        for feed, delta in now.items():
            if delta is None:
                continue
            # bounds that a scan can skip by; a week or a year ends before the next one begins
            near = F.lit(False) if low is None else (F.col("ymd") >= F.lit(low)) & (F.col("ymd") < F.date_add(F.lit(high), 367))
            rows = delta.where(near | F.col("ymd").isNull()).withColumn("period", self._period(grain))
            rows = rows.join(touched.withColumnRenamed("period", "p"), F.col("period").eqNullSafe(F.col("p")), "left_semi")
            merged = [getattr(F, MERGED[how])(m).cast(delta.schema[m].dataType).alias(m) for m, (how, _) in self.feeds[feed].measures.items()]
            tables[feed] = self._wide(feed, rows.groupBy(F.col("period").alias("ymd"), "pivot_key").agg(*merged), keys.get(feed, [] if self.feeds[feed].key else None))
        fresh = date_spine(tables).withColumn("bucket", _bucket())
        buckets = [r[0] for r in periods.select(F.col("period").alias("ymd")).select(_bucket().alias("b")).distinct().collect()]
        path = f"{self.root}/overall/{grain}"
        if _exists(self.spark, path):
            old = self._stored(grain).where(F.col("bucket").isin(buckets))
            kept = old.join(touched, F.col("ymd").eqNullSafe(F.col("period")), "left_anti")
            fresh = kept.unionByName(fresh, allowMissingColumns=True)
        fresh = materialize(fresh, "fresh")
        fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        # a correction may leave a bucket without rows
        left = {r[0] for r in fresh.select("bucket").distinct().collect()}
        for gone in set(buckets) - left:
            _delete(self.spark, f"{path}/bucket={gone}")
        discard(fresh, periods)
        return count

    def _stored(self, grain: str) -> DataFrame:
        """A mart as it is written, with the columns of all buckets; a bucket's name is text."""
        found = self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/overall/{grain}")
        return found.withColumn("bucket", _bucket())

    def read(self, grain: str) -> DataFrame:
        """The mart at a grain: ymd, and ``<feed>_<column>`` in order of name, null where a feed lacks the period."""
        found = self._stored(grain).drop("bucket")
        return found.select("ymd", *(f"`{c}`" for c in sorted(found.columns) if c != "ymd"))

    def follow(self, feed: str, raw_path: str, schema: T.StructType | str, state_path: str) -> StreamingQuery:
        """Load the files that ``raw_path`` has got since the last run, and refresh. A batch that is passed again changes nothing."""

        def apply(batch: DataFrame, number: int) -> None:
            self.load(feed, number, batch)
            self.refresh()

        return follow_files(self.spark, raw_path, schema, state_path, apply)
