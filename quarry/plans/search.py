"""Queries over the pivot index."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.pivots import PivotIndex
from quarry.plans.catalog import doubles, query
from quarry.plans.stand_ins import table


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.v, b.v) AS similarity FROM v a, v b WHERE a.vec_id % 4 = 0),
r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY ROUND(similarity, 9) DESC, id) AS INTEGER) AS rank FROM s)
SELECT query_id, id, rank, ROUND(similarity, 6) AS similarity FROM r WHERE rank <= 8"""
)
def pivot_top_k(spark, sf_dir):
    """The eight nearest vectors of every fourth one, itself included, by the pivot index."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found, _ = PivotIndex(vectors).top_k(vectors.where("id % 4 = 0").withColumnRenamed("id", "query_id"), 8, digits=9)
    return doubles(found.select("query_id", "id", "rank", "similarity"), "similarity")
