"""All queries of the library over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.columns import bits_to_hex, collapse_category, hex_to_bits, label_to_phase, version_filter
from quarry.operators import checks, layout, mart, randomness, reconcile, retrieve
from quarry.plans import stand_ins
from quarry.plans.stand_ins import SQL_BITS, SQL_PHASES, SQL_SALES, sql_deltas, table
from quarry.runtime import delete_on_exit, scratch_root
from quarry.sources.files import LayeredStore, json_fields, upsert_records, vector_record

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql.strip()
        return function

    return add


def doubles(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# ---- reconciliation ------------------------------------------------------------------------------------------------------

_DIFFS = ("a_metric_1", "a_metric_3", "a_total_metric", "b_metric_main", "b_metric_sub", "b_total_metric", "diff_main_metric", "diff_sub_metric", "diff_total_metric")
#: One stacked scan of both feeds, conditional sums by name, and pairs of names that may meet.
_SQL_CHECK = f"""
WITH {SQL_SALES},
stacked AS (
  SELECT 'a' AS part, batch_id, region_lv2, category AS name, metric_1 AS x, metric_3 AS y FROM source_a_detail WHERE version_flag = 1
  UNION ALL SELECT k.part, batch_id, region_lv2, IF(k.part = 'm', category_main, category_sub), IF(k.part = 'm', metric_main, metric_sub), NULL
  FROM source_b_data, (VALUES ('m'), ('s')) k(part) WHERE version_flag = IF(ends_with(batch_id, 'OW'), 3, 1)
),
sums AS (
  SELECT batch_id, region_lv2, name, list_distinct(list(part)) AS parts, SUM(x) FILTER (part = 'a') AS a1, SUM(y) FILTER (part = 'a') AS a3,
    SUM(x) FILTER (part = 'm') AS bm, SUM(x) FILTER (part = 's') AS bs FROM stacked GROUP BY ALL
),
may_meet AS (
  SELECT DISTINCT name AS left_name, name AS right_name FROM stacked UNION ALL VALUES ('MACHINERY', 'BUILDING'), ('HOUSEHOLD', 'FURNITURE')
),
c AS (
  SELECT batch_id, region_lv2, left_name AS category, p.a1 AS a_metric_1, p.a3 AS a_metric_3, p.a1 + p.a3 AS a_total_metric, q.bm AS b_metric_main, q.bs AS b_metric_sub,
    q.bm + COALESCE(q.bs, 0) AS b_total_metric, a_metric_1 - b_metric_main AS diff_main_metric, a_metric_3 - COALESCE(b_metric_sub, 0) AS diff_sub_metric,
    a_total_metric - b_total_metric AS diff_total_metric
  FROM sums p JOIN may_meet ON p.name = left_name JOIN sums q USING (batch_id, region_lv2) WHERE q.name = right_name AND 'a' IN p.parts AND 'm' IN q.parts
)
SELECT batch_id, region_lv2, category, {", ".join(f"ROUND(CAST({c} AS DOUBLE), 6) AS {c}" for c in _DIFFS)} FROM c
"""


def _check(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    a, b = stand_ins.source_a(spark, sf_dir), stand_ins.source_b(spark, sf_dir)
    return doubles(reconcile.consistency_check(a, b, stand_ins.SEGMENT_ALIASES, stand_ins.SUFFIX, **how), *_DIFFS)


@query(_SQL_CHECK)
def consistency_check(spark, sf_dir):
    return _check(spark, sf_dir)


@query(_SQL_CHECK)
def consistency_check_or_join(spark, sf_dir):
    return _check(spark, sf_dir, equi=False)


@query(_SQL_CHECK)
def consistency_check_stacked(spark, sf_dir):
    return _check(spark, sf_dir, stacked=True)


@query(
    f"""WITH {SQL_SALES},
a AS (SELECT DISTINCT batch_id, region_lv2, category FROM source_a_detail WHERE version_flag = 1),
b AS (SELECT DISTINCT batch_id, region_lv2, category_sub AS category FROM source_b_data WHERE version_flag = 3)
SELECT batch_id, region_lv2, category, CASE WHEN EXISTS (SELECT 1 FROM a x WHERE x.batch_id = u.batch_id AND x.region_lv2 = u.region_lv2 AND x.category = u.category)
  THEN 'a' ELSE 'b' END AS side
FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)) u"""
)
def outer_audit(spark, sf_dir):
    a = stand_ins.source_a(spark, sf_dir).where("version_flag = 1")
    b = stand_ins.source_b(spark, sf_dir).where("version_flag = 3").withColumnRenamed("category_sub", "category")
    return reconcile.outer_audit(a, b, ["batch_id", "region_lv2", "category"])


@query(
    """SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders
WHERE (RIGHT(o_orderpriority, 2) = 'OW' AND o_orderstatus = 'O') OR (RIGHT(o_orderpriority, 2) <> 'OW' AND o_orderstatus = 'F')"""
)
def version_filtered(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("v", F.expr("CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 3 ELSE 2 END"))
    return orders.where(version_filter(F.col("o_orderpriority"), F.col("v"), "OW")).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query(
    f"""WITH {SQL_SALES}, x AS (SELECT batch_id, region_lv2, SUM(metric_1) AS m, SUM(metric_3) AS t FROM source_a_detail WHERE version_flag = 1 GROUP BY ALL),
y AS (SELECT batch_id, region_lv2, SUM(metric_main) AS m, SUM(metric_sub) AS t FROM source_b_data WHERE version_flag = 3 GROUP BY ALL)
SELECT batch_id, region_lv2, ROUND(CAST(x.m AS DOUBLE), 6) AS a_m, ROUND(CAST(y.m AS DOUBLE), 6) AS b_m, ROUND(CAST(x.m - y.m AS DOUBLE), 6) AS diff_m,
  ROUND(CAST(x.t - y.t AS DOUBLE), 6) AS diff_t
FROM x JOIN y USING (batch_id, region_lv2) WHERE x.m <> y.m OR x.t <> y.t"""
)
def source_anomalies(spark, sf_dir):
    keys = ["batch_id", "region_lv2"]
    a = stand_ins.source_a(spark, sf_dir).where("version_flag = 1").groupBy(*keys).agg(F.sum("metric_1").alias("m"), F.sum("metric_3").alias("t"))
    b = stand_ins.source_b(spark, sf_dir).where("version_flag = 3").groupBy(*keys).agg(F.sum("metric_main").alias("m"), F.sum("metric_sub").alias("t"))
    found = reconcile.anomalies(reconcile.reconcile(a, b, keys, ["m", "t"], {"m": "1e-9"}), ["diff_m", "diff_t"])
    return doubles(found.select(*keys, "a_m", "b_m", "diff_m", "diff_t"), "a_m", "b_m", "diff_m", "diff_t")


@query(f"WITH {SQL_PHASES} SELECT * FROM scheduled")
def phase_spine(spark, sf_dir):
    spine = reconcile.phase_spine(reconcile.base_schedule(stand_ins.schedule(spark, sf_dir)))
    return spine.select("batch_id", "entity_id", "category_group", "phase", "period_label", "category_code", "category_name")


@query(f"WITH {SQL_PHASES} SELECT * FROM carried")
def forward_fill(spark, sf_dir):
    return reconcile.filled_spine(reconcile.base_schedule(stand_ins.schedule(spark, sf_dir)))


@query(
    f"""WITH {SQL_PHASES}, {sql_deltas('b')}
SELECT batch AS batch_id, region, phase, label AS period_label, name AS category_name, CAST(v AS DOUBLE) AS current_value, CAST(d AS DOUBLE) AS delta_value FROM deltas_b"""
)
def phase_delta(spark, sf_dir):
    return doubles(reconcile.phase_totals(stand_ins.external(spark, sf_dir), "metric_value"), "current_value", "delta_value")


_VALUES = ("source_a_current", "source_b_current", "source_a_delta", "source_b_delta", "diff_current", "diff_delta")


@query(
    f"""WITH {SQL_PHASES}, {sql_deltas('a')}, {sql_deltas('b')}
SELECT a.batch AS batch_id, a.region, a.phase, a.label AS period_label, a.name AS category_name, a.v::DOUBLE AS source_a_current, b.v::DOUBLE AS source_b_current,
  a.d::DOUBLE AS source_a_delta, b.d::DOUBLE AS source_b_delta, (a.v - b.v)::DOUBLE AS diff_current, (COALESCE(a.d, 0) - COALESCE(b.d, 0))::DOUBLE AS diff_delta
FROM deltas_a a JOIN deltas_b b ON (a.batch, a.region, a.phase, a.label, a.name) = (b.batch, b.region, b.phase, b.label, b.name)"""
)
def phase_comparison(spark, sf_dir):
    compared = reconcile.phase_comparison(stand_ins.schedule(spark, sf_dir), stand_ins.status(spark, sf_dir), stand_ins.external(spark, sf_dir))
    keys = ("batch_id", "region", "phase", "period_label", "category_name")
    return doubles(compared.select(*keys, *_VALUES), *_VALUES)


@query(
    """SELECT p_partkey, p_type, CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'compact' WHEN p_type IN ('LARGE', 'ECONOMY') THEN 'bulk' ELSE p_type END AS category_group FROM part"""
)
def category_collapse(spark, sf_dir):
    groups = {"compact": ("SMALL", "MEDIUM"), "bulk": ("LARGE", "ECONOMY")}
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", collapse_category(F.col("p_type"), groups).alias("category_group"))


@query(
    """SELECT period_label, CAST(REPLACE(period_label, 'P', '') AS INTEGER) - 1 AS phase, COUNT(*) AS rows
FROM (SELECT 'P' || l_linenumber AS period_label FROM lineitem) GROUP BY ALL"""
)
def label_phase(spark, sf_dir):
    labels = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), F.col("l_linenumber").cast("string")).alias("period_label"))
    return labels.groupBy("period_label", label_to_phase(F.col("period_label")).alias("phase")).agg(F.count("*").alias("rows"))


@query("SELECT l_orderkey, l_linenumber, COUNT(*) AS rows FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1")
def duplicate_keys(spark, sf_dir):
    return reconcile.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    """SELECT event_id, user_id, LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v
FROM (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)"""
)
def last_known_value(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return reconcile.last_known(events, "v", ["user_id"], "event_id")


# ---- marts -------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_nationkey, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def code_lookup(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = mart.code_lookup(table(spark, sf_dir, "customer"), nation, "c_nationkey", "n_nationkey", "n_name", "nation")
    named = mart.code_lookup(named, nation, "c_nationkey", "n_nationkey", "n_regionkey", "rk")
    return mart.code_lookup(named, region, "rk", "r_regionkey", "r_name", "region").select("c_custkey", "c_nationkey", "nation", "region")


_STATUS = ("F", "O", "P")
_PRIORITY = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _cells(keys: list[str], key: str, suffix: str) -> str:
    return ", ".join(f"MAX(CASE WHEN {key} = '{k}' THEN o_totalprice END) AS \"{k}{suffix}\"" for k in keys)


@query(f"SELECT CAST(o_orderdate AS DATE) AS ymd, {_cells(list(_STATUS), 'o_orderstatus', '_price')} FROM orders GROUP BY 1")
def pivot_static(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("ymd", F.col("o_orderdate").cast("date"))
    return mart.pivot_static(orders, ["ymd"], F.col("o_orderstatus"), _STATUS, "o_totalprice", "_price")


_COMPOSITE = [f"{s}_{p}" for s, p in product(_STATUS, _PRIORITY)]


@query(f"SELECT CAST(o_orderdate AS DATE) AS ymd, {_cells(_COMPOSITE, chr(40) + 'o_orderstatus || chr(95) || o_orderpriority' + chr(41), '_price')} FROM orders GROUP BY 1")
def pivot_composite(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("ymd", F.col("o_orderdate").cast("date"))
    return mart.dynamic_pivot(orders, ["ymd"], mart.composite_key("o_orderstatus", "o_orderpriority"), "o_totalprice", "_price")


@query("SELECT CAST(o_orderdate AS DATE) AS ymd, o_orderstatus AS pivot_key, MAX(o_totalprice) AS value FROM orders GROUP BY ALL")
def unpivoted(spark, sf_dir):
    return mart.unpivot(pivot_static(spark, sf_dir), ["ymd"], "_price")


@query(
    """WITH m AS (SELECT o_orderstatus, YEAR(o_orderdate)::INTEGER AS year, MONTH(o_orderdate)::INTEGER AS month, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS value FROM orders GROUP BY ALL)
SELECT a.o_orderstatus, a.year, a.month, CAST(a.value AS DOUBLE) AS value,
  ROUND((SELECT CAST(SUM(b.value) AS DOUBLE) / COUNT(*) FROM m b WHERE b.o_orderstatus = a.o_orderstatus AND b.month = a.month AND b.year <> a.year), 4) AS normal_value FROM m a"""
)
def normal_year_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    normal = mart.normal_year(orders, ["o_orderstatus"], "o_orderdate", "price").select("o_orderstatus", "year", "month", "value", "normal_value")
    return doubles(doubles(normal, "normal_value", digits=4), "value")


def _spine(grain: str):
    unit = mart.GRAINS[grain]
    sql = f"""WITH o AS (SELECT CAST(date_trunc('{unit}', o_orderdate) AS DATE) AS ymd, CAST(MAX(o_totalprice) AS DOUBLE) AS v FROM orders GROUP BY 1),
l AS (SELECT CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS ymd, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1),
e AS (SELECT CAST(date_trunc('{unit}', ts) AS DATE) AS ymd, CAST(MAX(value) AS DOUBLE) AS v FROM events GROUP BY 1),
s AS (SELECT ymd FROM o UNION SELECT ymd FROM l UNION SELECT ymd FROM e)
SELECT s.ymd, o.v AS orders_o_totalprice, l.v AS lineitem_quantity, e.v AS events_value FROM s LEFT JOIN o USING (ymd) LEFT JOIN l USING (ymd) LEFT JOIN e USING (ymd)"""

    def run(spark, sf_dir):
        tables = {
            "orders": table(spark, sf_dir, "orders"),
            "lineitem": table(spark, sf_dir, "lineitem").withColumn("quantity", F.col("l_quantity").cast("long")),
            "events": table(spark, sf_dir, "events"),
        }
        measures = {"orders": {"o_totalprice": "max"}, "lineitem": {"quantity": "sum"}, "events": {"value": "max"}}
        return mart.overall(tables, grain, measures, {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"})

    run.__name__ = f"date_spine_{grain}"
    return query(sql)(run)


for _grain in mart.GRAINS:
    _spine(_grain)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1996-02-29'")
def period_filter(spark, sf_dir):
    first, last = mart.month_window(date(1996, 3, 31))
    return mart.in_period(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", first, last)


@query(
    """SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(last_day(o_orderdate) AS DATE) AS month_end, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS month_before,
  strftime(o_orderdate, '%Y%m%d') AS ymd FROM orders"""
)
def month_end(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.withColumns(mart.month_ends(F.col("day")))


# ---- cleaning and checks -----------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE text IS NOT NULL AND trim(text) <> '' AND lang IS NOT NULL AND trim(lang) <> ''")
def clean_required(spark, sf_dir):
    return checks.drop_blank(table(spark, sf_dir, "documents"), ["text", "lang"]).select("doc_id", "lang", "source", "n_chars")


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_parsed(spark, sf_dir):
    return json_fields(table(spark, sf_dir, "events").select("event_id", "props"), "props", "k long").select("event_id", "k")


@query(
    """SELECT 'rows_present' AS "check", COUNT(*) > 0 AS passed, CAST(COUNT(*) AS VARCHAR) AS detail FROM orders
UNION ALL SELECT 'columns_present', COUNT(*) FILTER (column_name IS NULL) = 0, COALESCE(string_agg(c, ',' ORDER BY k) FILTER (column_name IS NULL), '')
  FROM (VALUES (1, 'o_orderkey'), (2, 'o_channel'), (3, 'o_orderdate'), (4, 'o_currency')) w(k, c) LEFT JOIN (DESCRIBE orders) ON column_name = c
UNION ALL SELECT 'dates_valid', COUNT(*) FILTER (o_orderdate IS NULL) = 0, CAST(COUNT(*) FILTER (o_orderdate IS NULL) AS VARCHAR) FROM orders
UNION ALL SELECT 'within_period', COUNT(*) FILTER (o_orderdate NOT BETWEEN DATE '1995-01-01' AND DATE '2000-12-31') = 0,
  CAST(COUNT(*) FILTER (o_orderdate NOT BETWEEN DATE '1995-01-01' AND DATE '2000-12-31') AS VARCHAR) FROM orders
UNION ALL SELECT 'newest_day', MAX(o_orderdate) IS NOT NULL, CAST(CAST(MAX(o_orderdate) AS DATE) AS VARCHAR) FROM orders"""
)
def load_completeness(spark, sf_dir):
    return checks.load_report(table(spark, sf_dir, "orders"), ["o_orderkey", "o_channel", "o_orderdate", "o_currency"], "o_orderdate", date(1995, 1, 1), date(2000, 12, 31))


@query("SELECT l_orderkey, COUNT(DISTINCT l_linestatus) AS items, COUNT(*) AS rows FROM lineitem GROUP BY 1 HAVING MIN(l_linestatus) = MAX(l_linestatus)")
def load_fault(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return checks.constant_loads(line, "l_orderkey", "l_linestatus", line)


@query(
    "SELECT 'o_orderkey' AS \"column\", COUNT(*) AS rows, COUNT(*) - COUNT(o_orderkey) AS nulls FROM orders UNION ALL SELECT 'o_orderstatus', COUNT(*), COUNT(*) - COUNT(o_orderstatus) FROM orders"
)
def missing_values(spark, sf_dir):
    return checks.null_counts(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus"])


@query(
    """WITH s AS (SELECT event_type, AVG(value) AS m, STDDEV_SAMP(value) AS d FROM events GROUP BY 1)
SELECT event_id, event_type, value, ROUND((value - m) / d, 6) AS zscore FROM events JOIN s USING (event_type) WHERE ABS((value - m) / d) > 3"""
)
def value_outliers(spark, sf_dir):
    found = checks.outliers(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "value", ["event_type"])
    return doubles(found.select("event_id", "event_type", "value", "zscore"), "zscore")


# ---- retrieval -----------------------------------------------------------------------------------------------------------


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query for each label: the mean of its vectors, to six digits so that the order of summation does not show."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    means = parts.groupBy("label", "p").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"])
    return means.groupBy(F.col("label").alias("query_id")).agg(vector.alias("vector"))


_SQL_SEARCH = """WITH p AS (SELECT vec_id, label, UNNEST(range(64)) AS p, UNNEST(embedding)::DOUBLE AS x FROM embeddings),
q AS (SELECT label AS query_id, p, ROUND(AVG(x), 6) AS m FROM p GROUP BY ALL),
qn AS (SELECT query_id, SQRT(SUM(m * m)) AS n FROM q GROUP BY 1), dn AS (SELECT vec_id, SQRT(SUM(x * x)) AS n FROM p GROUP BY 1),
d AS (SELECT query_id, vec_id, label, SUM(m * x) AS dot FROM q JOIN p USING (p) GROUP BY ALL),
s AS (SELECT query_id, vec_id, label, dot / (qn.n * dn.n) AS c FROM d JOIN qn USING (query_id) JOIN dn USING (vec_id) {0}),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id AS id, ROUND(c, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""


@query(_SQL_SEARCH.format(""))
def vector_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return doubles(retrieve.top_k(vectors, _centroids(spark, sf_dir), 10), "similarity").select("query_id", "id", "similarity", "rank")


@query(_SQL_SEARCH.format("WHERE label IN (1, 3, 5)"))
def vector_top_k_filtered(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 3, 5)).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return doubles(retrieve.top_k(vectors, _centroids(spark, sf_dir), 10), "similarity").select("query_id", "id", "similarity", "rank")


_SQL_RESULTS = _SQL_SEARCH.format("").replace("SELECT query_id, vec_id AS id,", ", o AS (SELECT query_id, vec_id AS id,") + ")"


@query(
    _SQL_RESULTS
    + """, x AS (SELECT * FROM o WHERE id % 7 <> 3), e AS (SELECT query_id, COUNT(*) AS n, MAX(rank) AS top, arg_max(similarity, rank) AS last, MAX(similarity) AS most,
  [s.similarity for s in list({'rank': rank, 'similarity': similarity} ORDER BY rank)] AS run FROM x GROUP BY 1),
f AS (SELECT MAX(n) AS n, bool_and(n = top) AS dense, bool_or(run <> list_reverse_sort(run)) AS rise, bool_and(most <= 1 + 1e-9) AS range FROM e)
SELECT 'at_most_k' AS "check", n <= 9 AS passed, n::VARCHAR AS detail FROM f UNION ALL SELECT 'ranks_without_gap', dense, dense::VARCHAR FROM f
UNION ALL SELECT 'similarity_falls', NOT rise, rise::VARCHAR FROM f UNION ALL SELECT 'similarity_in_range', range, range::VARCHAR FROM f"""
)
def retrieval_checks(spark, sf_dir):
    """The checks of a faulty result: some rows are lost, and ten are asked where nine are allowed."""
    return checks.retrieval_report(vector_top_k(spark, sf_dir).where("id % 7 <> 3"), 9)


@query(
    _SQL_SEARCH.format("")
    .replace("PARTITION BY query_id ORDER", "PARTITION BY query_id, label ORDER")
    .replace("SELECT query_id, vec_id AS id,", "SELECT query_id, label, vec_id AS id,")
    .replace("rank <= 10", "rank <= 2")
)
def vector_top_k_by_kind(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return doubles(retrieve.top_k(vectors, _centroids(spark, sf_dir), 2, by_kind="label"), "similarity").select("query_id", "label", "id", "similarity", "rank")


@query(
    _SQL_RESULTS
    + """, i AS (SELECT DISTINCT id FROM o), v AS (SELECT vec_id, p, x FROM p JOIN i ON vec_id = id)
SELECT a.vec_id AS a, b.vec_id AS b, ROUND(SUM(a.x * b.x) / (MAX(na.n) * MAX(nb.n)), 6) AS similarity FROM v a JOIN v b ON a.p = b.p AND a.vec_id < b.vec_id
JOIN dn na ON na.vec_id = a.vec_id JOIN dn nb ON nb.vec_id = b.vec_id GROUP BY ALL HAVING SUM(a.x * b.x) / (MAX(na.n) * MAX(nb.n)) >= 0.3"""
)
def similar_results(spark, sf_dir):
    """Pairs of similar vectors among the results of all searches."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = vectors.join(vector_top_k(spark, sf_dir).select("id").distinct(), "id")
    return doubles(retrieve.similar_pairs(found, 0.3), "similarity")


_SQL_GROUPS = r"""WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT id, w, UNNEST(range(1, GREATEST(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, COUNT(*) AS n FROM g GROUP BY 1),
f AS (SELECT g FROM g GROUP BY 1 HAVING COUNT(*) > 1),
c AS (SELECT x.id AS a, y.id AS b, COUNT(*) AS c FROM g x SEMI JOIN f ON x.g = f.g JOIN g y ON x.g = y.g AND x.id < y.id GROUP BY ALL),
e AS (SELECT a, b, c / (na.n + nb.n - c) AS s FROM c JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE c / (na.n + nb.n - c) >= 0.5),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT id, id AS o FROM w UNION SELECT reach.id, u.b FROM reach JOIN u ON u.a = reach.o),
groups AS (SELECT id, MIN(o) AS group_id FROM reach GROUP BY 1)"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.shingle_groups(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.length("text").alias("length")))


@query(_SQL_GROUPS + " SELECT id, group_id FROM groups")
def similar_groups(spark, sf_dir):
    return _groups(spark, sf_dir).select("id", "group_id")


@query(_SQL_GROUPS + " SELECT group_id, arg_min(id, {'l': -length(text), 'i': id}) AS id FROM groups JOIN documents ON doc_id = id GROUP BY 1")
def dedup_longest(spark, sf_dir):
    grouped = _groups(spark, sf_dir).select("group_id", "id", "length")
    return retrieve.longest_of_group(grouped, length="length").select("group_id", "id")


@query(
    r"""SELECT doc_id, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_id, 'text' AS kind, s AS text FROM (
  SELECT doc_id, UNNEST(range(len(l))) AS i, UNNEST(l) AS s FROM (
    SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents))"""
)
def sentence_chunks(spark, sf_dir):
    return retrieve.sentences(table(spark, sf_dir, "documents"))


@query(
    """WITH r AS (SELECT lang AS query_id, text, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS rank FROM documents)
SELECT query_id, COUNT(*)::INTEGER AS chunks, md5(string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM r WHERE rank <= 5 GROUP BY 1"""
)
def context_assembly(spark, sf_dir):
    order = Window.partitionBy("lang").orderBy(F.length("text").desc(), "doc_id")
    ranked = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), "text", F.row_number().over(order).alias("rank")).where("rank <= 5")
    return retrieve.assemble_context(ranked).select("query_id", "chunks", F.md5("context").alias("context_md5"))


# ---- randomness ----------------------------------------------------------------------------------------------------------


def bit_query(sql: str | None, function, *rounded: str, name: str, drop: tuple[str, ...] = ("seq_id",), digits: int = 6):
    """Register a statistic over the one long sequence."""

    def run(spark, sf_dir):
        return doubles(function(stand_ins.bits(spark, sf_dir)).drop(*drop), *rounded, digits=digits)

    run.__name__ = name
    return query(f"WITH {SQL_BITS}{sql}" if sql else None)(run)


bit_query(" SELECT COUNT(*) AS n, CAST(SUM(2 * bit - 1) AS BIGINT) AS s FROM bits", randomness.frequency, name="bit_frequency")
bit_query(
    """, b AS (SELECT idx // 128 AS b, SUM(bit) AS ones FROM bits GROUP BY 1 HAVING COUNT(*) = 128)
SELECT COUNT(*) AS blocks, ROUND(CAST(SUM((2 * ones - 128) * (2 * ones - 128)) AS DOUBLE) / 128, 6) AS chi2 FROM b""",
    randomness.block_frequency, "chi2", name="bit_block",
)
bit_query(
    """, c AS (SELECT bit, LAG(bit) OVER (ORDER BY idx) AS p FROM bits)
SELECT COUNT(*) AS n, CAST(SUM(bit) AS BIGINT) AS ones, COUNT(*) FILTER (bit <> p) + 1 AS runs FROM c""",
    randomness.runs, name="bit_runs",
)
_CLASSES = randomness.LONGEST_RUN[128][3]
bit_query(
    f""", i AS (SELECT idx // 8 AS b, bit, idx - ROW_NUMBER() OVER (PARTITION BY idx // 8, bit ORDER BY idx) AS island FROM bits),
r AS (SELECT b, bit, island, COUNT(*) AS l FROM i GROUP BY ALL),
m AS (SELECT b, COALESCE(MAX(l) FILTER (bit = 1), 0) AS longest FROM r GROUP BY 1 HAVING SUM(l) = 8),
v AS (SELECT COUNT(*) AS blocks, COUNT(*) FILTER (longest <= 1) AS v0, COUNT(*) FILTER (longest = 2) AS v1, COUNT(*) FILTER (longest = 3) AS v2, COUNT(*) FILTER (longest >= 4) AS v3 FROM m)
SELECT *, ROUND({" + ".join(f"pow(v{k} - blocks * {p}, 2) / (blocks * {p})" for k, p in enumerate(_CLASSES))}, 6) AS chi2 FROM v""",
    randomness.longest_run, "chi2", name="bit_longest_run",
)
_CYCLE = (
    ", s AS (SELECT COUNT(*) AS n FROM bits), y AS (SELECT idx, bit FROM bits UNION ALL SELECT idx + n, bit FROM bits, s WHERE idx < 8),"
    " z AS (SELECT idx, bit AS b0, LEAD(bit, 1) OVER o AS b1, LEAD(bit, 2) OVER o AS b2, LEAD(bit, 3) OVER o AS b3 FROM y WINDOW o AS (ORDER BY idx)),"
    " x AS (SELECT z.* FROM z, s WHERE idx < n),"
    " c1 AS (SELECT b0, COUNT(*) AS c FROM x GROUP BY ALL), c2 AS (SELECT b0, b1, COUNT(*) AS c FROM x GROUP BY ALL),"
    " c3 AS (SELECT b0, b1, b2, COUNT(*) AS c FROM x GROUP BY ALL), c4 AS (SELECT b0, b1, b2, b3, COUNT(*) AS c FROM x GROUP BY ALL),"
    " psi AS (SELECT n, (SELECT SUM(c * c) FROM c1) * 2.0::DOUBLE / n - n AS p1, (SELECT SUM(c * c) FROM c2) * 4.0::DOUBLE / n - n AS p2, (SELECT SUM(c * c) FROM c3) * 8.0::DOUBLE / n - n AS p3 FROM s),"
    " phi AS (SELECT n, (SELECT SUM(c / n * ln(c / n)) FROM c3) AS f3, (SELECT SUM(c / n * ln(c / n)) FROM c4) AS f4 FROM s)"
)
bit_query(_CYCLE + " SELECT n, ROUND(p3 - p2, 6) AS d1, ROUND(p3 - 2 * p2 + p1, 6) AS d2 FROM psi", randomness.serial, "d1", "d2", name="bit_serial")
bit_query(
    _CYCLE + " SELECT n, ROUND(f3 - f4, 6) AS apen, ROUND(2 * n * (ln(2) - (f3 - f4)), 4) AS chi2 FROM phi",
    lambda bits: doubles(randomness.approximate_entropy(bits), "chi2", digits=4), "apen", name="bit_approximate_entropy",
)
_WALK = (
    ", s AS (SELECT idx, SUM(2 * bit - 1) OVER (ORDER BY idx) AS s FROM bits),"
    " w AS (SELECT idx, s, SUM(CASE WHEN s = 0 THEN 1 ELSE 0 END) OVER (ORDER BY idx) - CASE WHEN s = 0 THEN 1 ELSE 0 END AS cycle FROM s),"
    " j AS (SELECT MAX(cycle) + 1 AS j FROM w)"
)
bit_query(
    _WALK + ", t AS (SELECT MIN(s) AS lo, MAX(s) AS hi, COUNT(*) AS n, arg_max(s, idx) AS e FROM s)"
    " SELECT 'forward' AS mode, n, CAST(GREATEST(ABS(lo), ABS(hi)) AS BIGINT) AS z FROM t"
    " UNION ALL SELECT 'backward', n, CAST(GREATEST(ABS(e - LEAST(lo, 0)), ABS(GREATEST(hi, 0) - e)) AS BIGINT) FROM t",
    randomness.cumulative_sums, name="bit_cusum",
)
_EXPECTED = ["(1 - 1 / (2.0::DOUBLE * ABS(state)))", *(f"(pow(1 - 1 / (2.0::DOUBLE * ABS(state)), {k - 1}) / (4 * state * state))" for k in range(1, 5)), "(pow(1 - 1 / (2.0::DOUBLE * ABS(state)), 4) / (2 * ABS(state)))"]
bit_query(
    _WALK + ", k AS (SELECT cycle, s AS state, COUNT(*) AS k FROM w WHERE ABS(s) BETWEEN 1 AND 4 GROUP BY ALL),"
    " g AS (SELECT UNNEST([-4, -3, -2, -1, 1, 2, 3, 4])::INTEGER AS state, CAST(j AS BIGINT) AS j FROM j),"
    " v AS (SELECT g.state, g.j, " + ", ".join(f"COUNT(*) FILTER (LEAST(k, 5) = {k}) AS v{k}" for k in range(1, 6)) + " FROM g LEFT JOIN k ON g.state = k.state GROUP BY ALL),"
    " f AS (SELECT *, j - v1 - v2 - v3 - v4 - v5 AS v0 FROM v)"
    " SELECT state, j, v0, v1, v2, v3, v4, v5, ROUND(" + " + ".join(f"pow(v{k} - j * {p}, 2) / (j * {p})" for k, p in enumerate(_EXPECTED)) + ", 6) AS chi2 FROM f",
    randomness.excursions, "chi2", name="bit_excursions",
)
bit_query(
    _WALK + ", k AS (SELECT s AS state, COUNT(*) AS k FROM w GROUP BY 1), g AS (SELECT UNNEST(range(-9, 10))::INTEGER AS state)"
    " SELECT g.state, CAST(j AS BIGINT) AS j, COALESCE(k, 0) AS xi FROM g CROSS JOIN j LEFT JOIN k ON g.state = k.state WHERE g.state <> 0",
    randomness.excursions_variant, name="bit_excursions_variant",
)
bit_query(
    """, w AS (SELECT idx // 4 + 1 AS i, SUM(bit * (8 >> CAST(idx % 4 AS INTEGER))) AS word FROM bits GROUP BY 1 HAVING COUNT(*) = 4),
l AS (SELECT i, i - COALESCE(LAG(i) OVER (PARTITION BY word ORDER BY i), 0) AS gap FROM w)
SELECT COUNT(*) AS k, ROUND(SUM(log2(gap)), 4) AS total, ROUND(SUM(log2(gap)) / COUNT(*), 6) AS fn FROM l WHERE i > 160""",
    lambda bits: doubles(randomness.universal(bits, 4).withColumn("k", F.col("k").cast("long")), "total", digits=4), "fn", name="bit_universal",
)
bit_query(
    """, o AS (SELECT idx // 1032 AS b, SUM(bit) OVER (PARTITION BY idx // 1032 ORDER BY idx ROWS 8 PRECEDING) AS ones FROM bits),
h AS (SELECT b, COUNT(*) FILTER (ones = 9) AS hits FROM o GROUP BY 1 HAVING COUNT(*) = 1032),
v AS (SELECT COUNT(*) AS blocks, """ + ", ".join(f"COUNT(*) FILTER (LEAST(hits, 5) = {k}) AS v{k}" for k in range(6)) + """ FROM h)
SELECT *, ROUND(""" + " + ".join(f"pow(v{k} - blocks * {p}, 2) / (blocks * {p})" for k, p in enumerate(randomness.OVERLAPPING)) + ", 6) AS chi2 FROM v",
    randomness.overlapping, "chi2", name="bit_overlapping",
)
bit_query(None, randomness.matrix_rank, "chi2", name="bit_matrix_rank")
bit_query(None, randomness.spectral_test, "d", "p_value", name="bit_spectral")
bit_query(
    ", s AS (SELECT COUNT(*) // 8 AS m FROM bits), w AS (SELECT idx, bit::VARCHAR || " + " || ".join(f"COALESCE(LEAD(bit, {j}) OVER o::VARCHAR, '')" for j in range(1, 9)) + """ AS g FROM bits WINDOW o AS (ORDER BY idx)),
g AS (SELECT g AS template FROM (SELECT lpad(bin(k), 9, '0') AS g FROM range(512) r(k)) WHERE """ + " AND ".join(f"substr(g, {j + 1}) <> substr(g, 1, {9 - j})" for j in range(1, 9)) + """),
h AS (SELECT g AS template, idx // m AS block, COUNT(*) AS hits FROM w, s WHERE idx % m <= m - 9 AND idx < m * 8 GROUP BY ALL)
SELECT template, COUNT(*) AS blocks, m, ROUND(SUM(pow(COALESCE(hits, 0) - (m - 8) / 512.0::DOUBLE, 2) / (m * (1 / 512.0::DOUBLE - 17 / 262144.0::DOUBLE))), 6) AS chi2
FROM g CROSS JOIN s CROSS JOIN range(8) b(block) LEFT JOIN h USING (template, block) GROUP BY ALL""",
    randomness.non_overlapping, "chi2", name="bit_non_overlapping",
)
bit_query(None, randomness.linear_complexity_test, "chi2", "p_value", name="bit_linear_complexity")
bit_query(" SELECT 0 AS seq_id, COUNT(*) AS n, TRUE AS valid FROM bits", randomness.well_formed, drop=(), name="bit_format")


@query()
def bit_verdicts(spark, sf_dir):
    """All fifteen tests and the combined verdict; p-values need functions that SQL lacks."""
    bits = randomness.gather_all(stand_ins.bits(spark, sf_dir))
    tests = {
        "frequency": randomness.frequency_test(bits),
        "block_frequency": randomness.block_frequency_test(bits),
        "runs": randomness.runs_test(bits),
        "longest_run": randomness.longest_run_test(bits),
        "matrix_rank": randomness.matrix_rank_test(bits),
        "spectral": randomness.spectral_test(bits),
        "non_overlapping": randomness.non_overlapping_test(bits),
        "overlapping": randomness.overlapping_test(bits),
        "universal": randomness.universal_test(bits),
        "approximate_entropy": randomness.approximate_entropy_test(bits),
        "excursions": randomness.excursions_test(bits),
        "excursions_variant": randomness.excursions_variant_test(bits),
        "serial": randomness.serial_test(bits),
        "linear_complexity": randomness.linear_complexity_test(bits),
        "cumulative_sums": randomness.cumulative_sums_test(bits),
    }
    return randomness.combined(tests)


@query(
    """SELECT h AS symbol, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 9) AS probability FROM (SELECT UNNEST(string_split(md5(text), '')) AS h FROM documents) GROUP BY 1"""
)
def hex_distribution(spark, sf_dir):
    symbols = table(spark, sf_dir, "documents").select(F.explode(F.split(F.md5("text"), "")).alias("symbol"))
    return doubles(randomness.symbol_distribution(symbols, "symbol"), "probability", digits=9)


@query(
    "SELECT doc_id, h AS hex, (bit_count(('0x' || substr(h, 1, 15))::BIGINT) + bit_count(('0x' || substr(h, 16, 15))::BIGINT) + bit_count(('0x' || substr(h, 31))::BIGINT))::INTEGER AS ones"
    " FROM (SELECT doc_id, md5(text) AS h FROM documents)"
)
def hex_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", hex_to_bits(F.md5("text")).alias("bits"))
    ones = F.length(F.replace(F.col("bits"), F.lit("0"), F.lit("")))
    return docs.select("doc_id", bits_to_hex(F.col("bits")).alias("hex"), ones.alias("ones"))


@query(
    """WITH m AS (SELECT AVG(value) AS m, COUNT(*) AS n FROM events), d AS (SELECT event_id, value - m AS d, n FROM events, m), p AS (SELECT SUM(d * d) AS p, MAX(n) AS n FROM d),
l AS (SELECT UNNEST(range(1, 11))::INTEGER AS lag)
SELECT lag, ROUND(SUM(a.d * b.d) / MAX(p.p), 6) AS r, ROUND(1.96 / SQRT(MAX(p.n)), 6) AS bound, ABS(SUM(a.d * b.d) / MAX(p.p)) <= 1.96 / SQRT(MAX(p.n)) AS independent
FROM (SELECT lag, d.event_id + lag AS other, d.d FROM d, l) a JOIN d b ON b.event_id = a.other, p GROUP BY lag"""
)
def autocorrelation(spark, sf_dir):
    series = table(spark, sf_dir, "events").select(F.lit(0).alias("seq_id"), F.col("event_id").alias("idx"), "value")
    return doubles(randomness.autocorrelation(series).drop("seq_id"), "r", "bound")


_MOST = 24


@query(
    f"""WITH h AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h FROM events), r AS (SELECT UNNEST(range((SELECT MIN(h) FROM h), (SELECT MAX(h) FROM h) + 1)) AS h),
c AS (SELECT r.h, COUNT(h.h) AS n FROM r LEFT JOIN h ON h.h = r.h GROUP BY 1), m AS (SELECT AVG(n) AS m, COUNT(*) AS b FROM c),
k AS (SELECT UNNEST(range({_MOST} + 1))::INTEGER AS k), o AS (SELECT LEAST(n, {_MOST}) AS k, COUNT(*) AS o FROM c GROUP BY 1),
e AS (SELECT k, b, exp(-m) * pow(m, k) / gamma(k + 1) AS p FROM k, m)
SELECT e.k, COALESCE(o.o, 0) AS observed, ROUND(b * CASE WHEN e.k < {_MOST} THEN p ELSE 1 - (SELECT SUM(p) FROM e WHERE k < {_MOST}) END, 6) AS expected
FROM e LEFT JOIN o ON o.k = e.k"""
)
def poisson_fit(spark, sf_dir):
    return doubles(randomness.poisson_fit(_hourly(spark, sf_dir), _MOST).drop("seq_id"), "expected")


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = table(spark, sf_dir, "events").select(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("bin"))
    range_ = hours.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("bin"))
    return range_.join(hours.groupBy("bin").agg(F.count("*").alias("n")), "bin", "left").select(F.lit(0).alias("seq_id"), "bin", F.coalesce("n", F.lit(0)).alias("n"))


#: Counts of five and more are pooled, so that no expected number is tiny.
_POOLED = 5


@query(
    f"""WITH f AS ({ORACLES["poisson_fit"].replace(str(_MOST), str(_POOLED))}),
c AS (SELECT SUM(pow(observed - expected, 2) / expected) AS chi2, COUNT(*) - 2 AS freedom FROM f WHERE expected > 0),
g AS (SELECT chi2, freedom, SUM(exp(freedom / 2.0::DOUBLE * ln(chi2 / 2) - chi2 / 2 + i * ln(chi2 / 2) - lgamma(freedom / 2.0::DOUBLE + i + 1))) AS below
  FROM c, range(4000) r(i) GROUP BY ALL)
SELECT ROUND(chi2, 2) AS chi2, freedom, ROUND(1 - below, 4) AS p_value, 1 - below >= 0.01 AS passed FROM g"""
)
def poisson_test(spark, sf_dir):
    """The regularised gamma function is a power series in SQL."""
    tested = randomness.poisson_test(_hourly(spark, sf_dir), _POOLED)
    return tested.select(F.round("chi2", 2).alias("chi2"), F.col("freedom").cast("long").alias("freedom"), F.round("p_value", 4).alias("p_value"), "passed")


# ---- layout: each order is a page with a heading and a table of its lines, each document a page of its words ------------

_FIELDS = ("l_quantity", "l_discount", "l_tax", "l_returnflag")


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of 50 by 20 points whose edges are a little off; a value of zero has no cell."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in _FIELDS))
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    cells = F.posexplode(F.array(*(F.col(c).cast("string") for c in _FIELDS))).alias("c", "v")
    cells = lines.withColumn("r", row).select(F.col("l_orderkey").alias("doc_id"), "r", cells).where("v <> '0.0'")
    x, y = F.col("c") * 50 + (F.col("r") % 3) * 0.25, 100 + F.col("r") * 20 + (F.col("c") % 2) * 0.5

    def element(kind, x, y, w, h, text, size):
        nothing = lambda v, t: F.lit(v).cast(t)
        return F.struct(F.lit(1).alias("page"), F.lit(kind).alias("kind"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(w).alias("width"), F.lit(h).alias("height"), text.alias("text") if text is not None else nothing(None, "string").alias("text"), nothing(size, "double").alias("font_size"))

    both = cells.select("doc_id", F.inline(F.array(element("rect", x, y, 50.0, 20.0, None, None), element("char", x + 20, y + 6, 5.0, 8.0, F.col("v"), 10.0))))
    heads = lines.select(F.col("l_orderkey").alias("doc_id")).distinct()
    marks = (("Order ", 60, 95), ("Lines in table form", 70, 80), ("far above", 60, 20), ("left of it", -20, 99), ("(Unit: pieces) ", -30, 90))
    foot = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("n")).where("doc_id % 3 <> 0")
    foot = foot.select("doc_id", F.inline(F.array(element("char", F.lit(10), 125 + F.col("n") * 20, 5.0, 8.0, F.concat(F.lit("Note on "), F.col("doc_id").cast("string")), 9.0))))
    heads = heads.select("doc_id", F.inline(F.array(*(element("char", F.lit(x), F.lit(y), 5.0, 8.0, F.concat(F.lit(t), F.col("doc_id").cast("string")), 12.0 + k) for k, (t, x, y) in enumerate(marks)))))
    return both.union(heads).union(foot)


_SQL_CELLS = """WITH g AS (SELECT l_orderkey, l_linenumber, [printf('%.1f', MIN(l_quantity)), CAST(MIN(l_discount) AS VARCHAR), CAST(MIN(l_tax) AS VARCHAR), MIN(l_returnflag)] AS v FROM lineitem GROUP BY ALL),
r AS (SELECT l_orderkey AS doc_id, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r, v FROM g),
k AS (SELECT doc_id, r, c, v[c + 1] AS t FROM r, range(4) n(c) WHERE t <> '0.0'),
cols AS (SELECT doc_id, c, DENSE_RANK() OVER (PARTITION BY doc_id ORDER BY c) AS col, x FROM (SELECT doc_id, c, MIN(c * 50 + (r % 3) * 0.25) AS x FROM k GROUP BY ALL)),
m AS (SELECT rows.doc_id, rows.r AS row, col, COALESCE(k.c * 50 + (k.r % 3) * 0.25, cols.x)::DOUBLE AS x, COALESCE(100 + k.r * 20 + (k.c % 2) * 0.5, rows.y)::DOUBLE AS y,
  k.t IS NULL AS is_filled, COALESCE(k.t, '') AS text
  FROM (SELECT doc_id, r, MIN(100 + r * 20 + (c % 2) * 0.5) AS y FROM k GROUP BY ALL) rows JOIN cols USING (doc_id) LEFT JOIN k ON k.doc_id = rows.doc_id AND k.r = rows.r AND k.c = cols.c)"""


@query(_SQL_CELLS + " SELECT doc_id, 1 AS page, row, col, x, y, is_filled, text FROM m")
def table_fill(spark, sf_dir):
    return layout.rebuild_tables(_elements(spark, sf_dir)).select("doc_id", "page", "row", "col", "x", "y", "is_filled", "text")


@query(
    _SQL_CELLS + """, l AS (SELECT doc_id, row, '| ' || string_agg(text, ' | ' ORDER BY col) || ' |' AS l, COUNT(*) AS w FROM m GROUP BY ALL)
SELECT doc_id, string_agg(l || CASE WHEN row = 1 THEN chr(10) || '|' || repeat(' --- |', w) ELSE '' END, chr(10) ORDER BY row) AS markdown FROM l GROUP BY 1"""
)
def table_markdown(spark, sf_dir):
    return layout.to_markdown(layout.rebuild_tables(_elements(spark, sf_dir))).select("doc_id", "markdown")


@query(
    r"""SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY i) AS line, array_to_string(list_filter(string_split_regex(l, '[ \t]+'), lambda w: w <> ''), '') AS text
FROM (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(l, '[^ \t]')"""
)
def line_rebuild(spark, sf_dir):
    return layout.rebuild_lines(_words(spark, sf_dir)).select("doc_id", "line", "text")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of a document as a character of a page, a little off its line."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("l", "line"))
    words = lines.select("doc_id", "l", F.posexplode(F.filter(F.split("line", r"[ \t]+"), lambda w: w != "")).alias("w", "text"))
    return words.select("doc_id", F.lit(1).alias("page"), (F.col("w") * 6.0).alias("x"), (F.col("l") * 12.0 + (F.col("w") % 4) * 0.5).alias("y"), "text", F.lit(10.0).alias("font_size"))


@query(
    r"""WITH l AS (SELECT doc_id, i, array_to_string(list_filter(string_split_regex(l, '[ \t]+'), lambda w: w <> ''), '') AS t, i - ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY i) AS island
FROM (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(l, '[^ \t]'))
SELECT doc_id, DENSE_RANK() OVER (PARTITION BY doc_id ORDER BY island) AS paragraph, string_agg(t, ' ' ORDER BY i) AS text FROM l GROUP BY doc_id, island"""
)
def paragraph_rebuild(spark, sf_dir):
    return layout.paragraphs(layout.rebuild_lines(_words(spark, sf_dir))).select("doc_id", "paragraph", "text")


@query(
    _SQL_CELLS + """ SELECT doc_id, 1::BIGINT AS "table", 'Order ' || doc_id AS title, '(Unit: pieces) ' || doc_id AS unit, CASE WHEN doc_id % 3 <> 0 THEN 'Note on ' || doc_id END AS note
FROM m GROUP BY ALL"""
)
def title_match(spark, sf_dir):
    """Tables with their titles, units and notes."""
    chars, rects = layout.split_kinds(_elements(spark, sf_dir))
    lines = layout.rebuild_lines(chars)
    edges = F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("y") + F.col("height")).alias("bottom")
    tables = layout.table_cells(rects).groupBy("doc_id", "page", "table").agg(*edges)
    named = layout.match_notes(lines, layout.match_units(lines, layout.match_titles(lines, tables)))
    return named.select("doc_id", "table", "title", "unit", "note")


# ---- collected files --------------------------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(ROUND(o_totalprice, 2) AS DECIMAL(18,2)) AS price FROM orders
WHERE o_orderkey % 10 <> 3 AND o_orderkey % 11 <> 5 AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01'"""
)
def collected_files(spark, sf_dir):
    """Files as they come: dates and numbers as text, some of them blank or broken, a column nobody wants."""
    raw = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 10 == 3, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy/MM/dd"))).alias("day"),
        F.when(F.col("o_orderkey") % 11 == 5, F.lit("  ")).otherwise(F.format_number(F.round("o_totalprice", 2).cast("decimal(18,2)"), 2)).alias("price"),
        F.lit("memo").alias("memo"),
    )
    period = ("day", date(1996, 1, 1), date(1997, 12, 31))
    return checks.clean(raw, ["o_orderkey", "day", "price"], {"day": "yyyy/MM/dd"}, {"price": "decimal(18,2)"}, period, ["o_orderkey", "day", "price"])


@query(
    """WITH n AS (SELECT o_orderpriority, month(o_orderdate) AS month, ROUND(AVG(o_totalprice), 4) AS price FROM orders WHERE o_orderstatus = 'F' AND month(o_orderdate) < 12 GROUP BY ALL)
SELECT o_orderkey, o_totalprice AS price, n.price AS normal_price FROM orders LEFT JOIN n ON n.o_orderpriority = orders.o_orderpriority AND n.month = month(o_orderdate)"""
)
def normal_prices(spark, sf_dir):
    """Current prices beside loaded normal-year prices, which lack a month."""
    orders = table(spark, sf_dir, "orders").withColumn("month", F.month("o_orderdate"))
    loaded = orders.where("o_orderstatus = 'F' and month < 12").groupBy("o_orderpriority", "month").agg(F.round(F.avg("o_totalprice"), 4).alias("price"))
    current = orders.select("o_orderkey", "o_orderpriority", "month", F.col("o_totalprice").alias("price"))
    return mart.with_normal(current, loaded, ["o_orderpriority", "month"]).select("o_orderkey", "price", "normal_price")


@query(
    """SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 3 = 0 THEN 2030 ELSE 2020 + vec_id % 5 END::INTEGER AS year, 'label ' || label AS item,
  printf('%04d-%02d label %d', CASE WHEN vec_id % 3 = 0 THEN 2030 ELSE 2020 + vec_id % 5 END, 1 + vec_id % 12, label) AS document, len(embedding)::INTEGER AS size
FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 5 >= 2"""
)
def vector_store(spark, sf_dir):
    """Records of a vector store, a third of them replaced by newer ones that came twice, restricted by their metadata."""
    vectors = table(spark, sf_dir, "embeddings")

    def records(year):
        month, item = 1 + F.col("vec_id") % 12, F.concat(F.lit("label "), F.col("label").cast("string"))
        name = retrieve.document_name(year.cast("int"), month.cast("int"), item)
        return vector_record(F.col("vec_id"), F.col("embedding"), year, month, item, name)

    newer = vectors.where("vec_id % 3 = 0").select(*records(F.lit(2030)))
    stored = upsert_records(vectors.select(*records(2020 + F.col("vec_id") % 5)), newer.union(newer))
    found = stored.where("metadata.year >= 2022")
    return found.select("id", "metadata.year", "metadata.item", "document", F.size("vector").alias("size"))


@query(
    """SELECT o_orderstatus AS status, COUNT(*) AS rows, SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END)::BIGINT AS cents
FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 UNION ALL SELECT 'raw', COUNT(*), NULL FROM orders"""
)
def layered_store(spark, sf_dir):
    """A raw table that grew by two loads, and a pivot table of which a correction replaced one partition."""
    store = LayeredStore(spark, f"{scratch_root(spark)}/store-{uuid.uuid4().hex}")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    for load in (orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1")):
        store.write(load, "raw", "orders")
    delete_on_exit(spark, store.root)
    raw = store.read("raw", "orders")
    store.write(raw.where("status <> 'P'"), "pivot", "orders", ["status"])
    store.write(raw.where("status = 'F'").withColumn("cents", F.col("cents") * 2), "pivot", "orders", ["status"])
    pivot = store.read("pivot", "orders").groupBy("status").agg(F.count("*").alias("rows"), F.sum("cents").alias("cents"))
    return pivot.union(raw.agg(F.lit("raw").alias("status"), F.count("*").alias("rows"), F.lit(None).cast("long").alias("cents")))


flagship = consistency_check
