"""Queries over layouts that the catalogue's pages do not have."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import layout
from quarry.plans.catalog import query
from quarry.plans.stand_ins import table


@query(
    """SELECT l_orderkey AS doc_id, COUNT(*) AS cells, 20.0::DOUBLE + 20 * (COUNT(*) - 1) AS lowest FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
GROUP BY 1 HAVING COUNT(*) > 1"""
)
def tables_kept(spark, sf_dir):
    """Each order as a page with a box for each line, one below the other: an order of one line is a single box, which is no table and goes."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber").distinct()
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy("l_linenumber"))
    edges = {"page": F.lit(1), "x": F.lit(10.0), "y": (row * 20).cast("double"), "width": F.lit(50.0), "height": F.lit(20.0)}
    cells = layout.fill_cells(layout.table_cells(lines.withColumns(edges)))
    return cells.groupBy("doc_id").agg(F.count("*").alias("cells"), F.max("y").alias("lowest"))
