"""Queries over exact quantiles."""

from __future__ import annotations

from quarry.operators import selection
from quarry.plans.catalog import query
from quarry.plans.stand_ins import table


@query(
    """SELECT l_returnflag, l_linestatus, q, n, quantile FROM (
  SELECT l_returnflag, l_linestatus, COUNT(*) AS n, quantile_disc(l_extendedprice::DOUBLE, [0.05, 0.25, 0.5, 0.75, 0.95]) AS v FROM lineitem GROUP BY 1, 2
), LATERAL (SELECT unnest([0.05::DOUBLE, 0.25, 0.5, 0.75, 0.95]) AS q, unnest(v) AS quantile)"""
)
def exact_quantiles(spark, sf_dir):
    return selection.exact_quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", (0.05, 0.25, 0.5, 0.75, 0.95), ["l_returnflag", "l_linestatus"])


@query(
    """WITH f AS (SELECT event_type, quantile_disc(value, 0.25) AS a, quantile_disc(value, 0.75) AS b FROM events GROUP BY 1)
SELECT event_id, event_type, value, a - 1.5 * (b - a) AS low, b + 1.5 * (b - a) AS high FROM events JOIN f USING (event_type) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)"""
)
def robust_outliers(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return selection.beyond_fences(events, "value", ["event_type"])
