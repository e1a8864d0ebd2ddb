"""Queries over one group of all rows, by scans of ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import reconcile
from quarry.operators.prefix import Running, scan
from quarry.plans import stand_ins
from quarry.plans.catalog import ORACLES, doubles, query
from quarry.plans.stand_ins import table


@query(
    """WITH e AS (SELECT event_id, event_type, value, CASE WHEN event_type = 'purchase' THEN value END AS v, SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS g FROM events)
SELECT event_id, LAST_VALUE(v IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_purchase, CAST(g AS BIGINT) AS purchases,
  ROUND(MAX(value) OVER (PARTITION BY g ORDER BY event_id), 6) AS most_since, COUNT(*) OVER (PARTITION BY g ORDER BY event_id) AS events_since FROM e"""
)
def running_events(spark, sf_dir):
    """All events as one sequence: the last purchase so far, and what there was since it."""
    bought = F.col("event_type") == "purchase"
    events = table(spark, sf_dir, "events").select("event_id", "value", F.when(bought, F.col("value")).alias("v"), bought.alias("bought"), F.when(bought, 1).alias("one"), F.lit(1).alias("every"))
    values = {
        "last_purchase": Running("last", "v"), "purchases": Running("count", "one"), "most_since": Running("max", "value", "bought"), "events_since": Running("count", "every", "bought"),
    }
    found = scan(events, [F.col("event_id")], [], values)
    return doubles(found.select("event_id", *values), "most_since")


@query(ORACLES["forward_fill"])
def forward_fill_scanned(spark, sf_dir):
    """The fill of :func:`forward_fill` as every entity has it if it is scanned by ranges."""
    return reconcile.filled_spine(reconcile.base_schedule(stand_ins.schedule(spark, sf_dir)), most=0)
