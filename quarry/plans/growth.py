"""Queries over marts that grow by loads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import mart
from quarry.plans.catalog import query
from quarry.plans.stand_ins import table
from quarry.runtime import delete_on_exit, scratch_root
from quarry.streaming.marts import Feed, GrowingMart

_FEEDS = {
    "orders": Feed("o_orderdate", {"price": ("max", "o_totalprice")}, ("o_orderstatus",), "_price"),
    "lineitem": Feed("l_shipdate", {"quantity": ("sum", "quantity"), "rows": ("count", "quantity")}),
    "events": Feed("ts", {"value": ("max", "value")}),
}
_IDS = {"orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id"}


def _full(unit: str) -> str:
    """A build of all rows at once."""
    return f"""
SELECT '{unit}' AS grain, s.ymd, o.F AS "orders_F_price", o.O AS "orders_O_price", o.P AS "orders_P_price", l.q AS lineitem_quantity, l.n AS lineitem_rows, e.v AS events_value FROM (
  SELECT CAST(date_trunc('{unit}', o_orderdate) AS DATE) AS ymd FROM orders UNION SELECT CAST(date_trunc('{unit}', l_shipdate) AS DATE) FROM lineitem
  UNION SELECT CAST(date_trunc('{unit}', ts) AS DATE) FROM events
) s LEFT JOIN (
  SELECT CAST(date_trunc('{unit}', o_orderdate) AS DATE) AS ymd, MAX(o_totalprice) FILTER (o_orderstatus = 'F') AS F, MAX(o_totalprice) FILTER (o_orderstatus = 'O') AS O,
    MAX(o_totalprice) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1
) o USING (ymd) LEFT JOIN (
  SELECT CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS ymd, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, COUNT(l_quantity) AS n FROM lineitem GROUP BY 1
) l USING (ymd) LEFT JOIN (SELECT CAST(date_trunc('{unit}', ts) AS DATE) AS ymd, MAX(value) AS v FROM events GROUP BY 1) e USING (ymd)"""


def _sources(spark, sf_dir) -> dict[str, DataFrame]:
    """The feeds' rows with the number of the load that brings them; loads overlap in dates."""
    rows = {name: table(spark, sf_dir, name) for name in _FEEDS}
    rows["lineitem"] = rows["lineitem"].withColumn("quantity", F.col("l_quantity").cast("long"))
    return {name: df.withColumn("load", F.pmod(F.xxhash64(_IDS[name]), F.lit(3)).cast("int")) for name, df in rows.items()}


def _grown(spark, sf_dir, grains: tuple[str, ...]) -> GrowingMart:
    """The marts after three loads of each feed: one passed twice, one wrong at first and corrected, and refreshes between them."""
    grown = GrowingMart(spark, f"{scratch_root(spark)}/mart-{uuid.uuid4().hex}", _FEEDS, grains)
    sources = _sources(spark, sf_dir)
    for name, rows in sources.items():
        grown.load(name, 0, rows.where("load = 0").drop("load"))
    delete_on_exit(spark, grown.root)
    grown.load("orders", 1, sources["orders"].where("load = 2").withColumn("o_totalprice", F.col("o_totalprice") * 10).drop("load"))
    grown.refresh()
    grown.load("events", 0, sources["events"].drop("load"))
    for name, rows in sources.items():
        grown.load(name, 1, rows.where("load = 1").drop("load"), correct=name == "orders")
        grown.load(name, 2, rows.where("load = 2").drop("load"))
    grown.refresh()
    return grown


@query(f"{_full('day')} UNION ALL {_full('month')}")
def growing_marts(spark, sf_dir):
    """Daily and monthly marts that grew, which must equal a full build."""
    grown = _grown(spark, sf_dir, ("daily", "monthly"))
    parts = [grown.read(grain).select(F.lit(mart.GRAINS[grain]).alias("grain"), "*") for grain in grown.grains]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


@query(
    """SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) > (SELECT MAX(CAST(ts AS DATE)) FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(MIN(ts) AS DATE) + CAST((CAST(MAX(ts) AS DATE) - CAST(MIN(ts) AS DATE)) // 2 AS INTEGER) FROM events))"""
)
def newer_rows(spark, sf_dir):
    """What a second collection of the events has to load, after a first one that ended halfway through their dates."""
    events = table(spark, sf_dir, "events")
    at = F.col("ts").cast("date")
    ends = events.agg(F.min(at).alias("a"), F.max(at).alias("b")).select("a", F.floor(F.date_diff("b", "a") / 2).cast("int").alias("n")).select(F.date_add("a", F.col("n")).alias("half")).first()
    grown = GrowingMart(spark, f"{scratch_root(spark)}/mart-{uuid.uuid4().hex}", {"events": _FEEDS["events"]}, ("daily",))
    grown.load("events", 1, events.where(at < F.lit(ends["half"])))
    delete_on_exit(spark, grown.root)
    return grown.only_newer("events", events).select("event_id", "ts")
