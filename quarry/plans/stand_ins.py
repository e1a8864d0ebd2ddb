"""The driver's tables in the shape that the operators expect, for Spark and, as text, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.prefix import global_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- two feeds for the consistency check -------------------------------------------------------------------------

SUFFIX = "OW"
SEGMENT_ALIASES = {"MACHINERY": "BUILDING", "HOUSEHOLD": "FURNITURE"}
_VERSION = "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 3 ELSE 2 END"


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customer, nation, region = (table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def source_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sales(spark, sf_dir).selectExpr(
        "o_orderpriority AS batch_id",
        "r_name AS region_lv1",
        "n_name AS region_lv2",
        "c_mktsegment AS category",
        "CAST(l_quantity AS DECIMAL(18,6)) AS metric_1",
        "CAST(l_discount AS DECIMAL(18,6)) AS metric_2",
        "CAST(l_tax AS DECIMAL(18,6)) AS metric_3",
        f"{_VERSION} AS version_flag",
    )


def source_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sales(spark, sf_dir).selectExpr(
        "o_orderpriority AS batch_id",
        "n_name AS region_lv2",
        "CASE WHEN c_mktsegment = 'MACHINERY' AND l_linenumber % 2 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS category_main",
        "CASE WHEN l_returnflag = 'R' THEN 'BUILDING' ELSE c_mktsegment END AS category_sub",
        "CAST(l_quantity AS DECIMAL(18,6)) AS metric_main",
        "CAST(l_tax AS DECIMAL(18,6)) AS metric_sub",
        f"{_VERSION} AS version_flag",
    )


SQL_SALES = """
sales AS (
  SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
source_a_detail AS (
  SELECT o_orderpriority AS batch_id, r_name AS region_lv1, n_name AS region_lv2, c_mktsegment AS category,
    CAST(l_quantity AS DECIMAL(18,6)) AS metric_1, CAST(l_discount AS DECIMAL(18,6)) AS metric_2, CAST(l_tax AS DECIMAL(18,6)) AS metric_3,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 3 ELSE 2 END AS version_flag
  FROM sales
),
source_b_data AS (
  SELECT o_orderpriority AS batch_id, n_name AS region_lv2,
    CASE WHEN c_mktsegment = 'MACHINERY' AND l_linenumber % 2 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS category_main,
    CASE WHEN l_returnflag = 'R' THEN 'BUILDING' ELSE c_mktsegment END AS category_sub,
    CAST(l_quantity AS DECIMAL(18,6)) AS metric_main, CAST(l_tax AS DECIMAL(18,6)) AS metric_sub,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 3 ELSE 2 END AS version_flag
  FROM sales
)"""


# ---- schedule, status and external feed for the phase comparison ---------------------------------------------------

_NAME = "CASE l_orderkey % 5 WHEN 0 THEN 'type_a1' WHEN 1 THEN 'type_a2' WHEN 2 THEN 'type_b1' WHEN 3 THEN 'type_b2' ELSE 'type_c' END"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_returnflag", "l_orderkey", "l_linenumber"]
    quantity = F.sum(F.col("l_quantity").cast("decimal(18,6)"))
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(quantity.alias("quantity"), (F.min("l_partkey") % 7).alias("code"))


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).selectExpr(
        "l_returnflag AS batch_id",
        "l_orderkey AS entity_id",
        "concat('P', cast(l_linenumber AS string)) AS period_label",
        "concat('c', cast(code AS string)) AS category_code",
        f"{_NAME} AS category_name",
    )


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).selectExpr(
        "l_returnflag AS batch_id",
        "l_orderkey AS entity_id",
        "concat('r', cast(l_orderkey % 4 AS string)) AS region",
        "l_linenumber AS phase",
        f"{_NAME} AS category_name",
        "'on' AS status_flag",
        "quantity AS value_current",
    )


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).selectExpr(
        "l_returnflag AS batch_id",
        "concat('r', cast(l_orderkey % 4 AS string)) AS region",
        "l_linenumber AS phase",
        "concat('P', cast(least(l_linenumber + 1, 6) AS string)) AS period_label",
        f"{_NAME} AS category_name",
        "quantity AS metric_value",
    )


#: What the schedule says of each entity as a list of steps, from which spine and fill are read off; no join, window or running sum.
SQL_PHASES = f"""
lines AS (
  SELECT l_returnflag, l_orderkey, l_linenumber, SUM(CAST(l_quantity AS DECIMAL(18,6))) AS quantity, MIN(l_partkey) % 7 AS code
  FROM lineitem GROUP BY ALL
),
plans AS (
  SELECT l_returnflag AS batch, l_orderkey AS entity, {_NAME} AS name, regexp_replace(name, '^(type_[ab])[12]$', '\\1') AS family,
    list({{'ph': l_linenumber - 1, 'label': 'P' || l_linenumber, 'code': 'c' || code}} ORDER BY l_linenumber) AS steps
  FROM lines GROUP BY ALL
),
grid AS (
  SELECT batch, entity, name, family, phases.ph, list_filter(steps, lambda s: s.ph = phases.ph) AS now, list_filter(steps, lambda s: s.ph BETWEEN 1 AND phases.ph) AS past
  FROM plans, (VALUES (1), (2), (3), (4), (5)) phases(ph)
),
scheduled AS (
  SELECT batch AS batch_id, entity AS entity_id, family AS category_group, ph AS phase, now[1].label AS period_label, now[1].code AS category_code,
    CASE WHEN len(now) > 0 THEN name END AS category_name FROM grid
),
carried AS (
  SELECT batch AS batch_id, entity AS entity_id, ph AS phase, family AS category_group, len(past) AS grp, past[-1].code AS category_code,
    CASE WHEN len(past) > 0 THEN name END AS category_name, list_max([s.label for s in past]) AS period_label FROM grid
),
values_b AS (
  SELECT l_returnflag AS batch, 'r' || (l_orderkey % 4) AS region, l_linenumber AS phase, 'P' || LEAST(l_linenumber + 1, 6) AS label, {_NAME} AS name, quantity AS x FROM lines
),
values_a AS (
  SELECT c.batch_id AS batch, 'r' || (l.l_orderkey % 4) AS region, c.phase, c.period_label AS label, c.category_name AS name, l.quantity AS x
  FROM lines l JOIN carried c ON (l.l_returnflag, l.l_orderkey, l.l_linenumber) = (c.batch_id, c.entity_id, c.phase)
)"""


def sql_deltas(source: str) -> str:
    """Sums of a source's values, and beside each the nearest one before it in order of phase, then label."""
    return f"""
sums_{source} AS (SELECT batch, region, name, phase, label, SUM(x) AS v, struct_pack(p := COALESCE(phase, 99), l := COALESCE(label, '~')) AS place FROM values_{source} GROUP BY ALL),
deltas_{source} AS (
  SELECT u.batch, u.region, u.name, u.phase, u.label, u.v,
    CASE WHEN u.phase <> 1 THEN (SELECT arg_max(w.v, w.place) FROM sums_{source} w
      WHERE w.batch = u.batch AND w.region = u.region AND w.name IS NOT DISTINCT FROM u.name AND w.place < u.place) - u.v END AS d
  FROM sums_{source} u
)"""


# ---- one long sequence of bits ---------------------------------------------------------------------------------------

_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parity of each line's price in cents, in the total order of all columns; equal rows have equal bits."""
    parity = F.pmod(F.round(F.col("l_extendedprice") * 100).cast("long"), F.lit(2)).cast("tinyint")
    lines = table(spark, sf_dir, "lineitem").select(*_LINE, parity.alias("bit"))
    ordered = global_index(lines, [F.col(c) for c in _LINE], keep=["bit"])
    return ordered.select(F.lit(0).alias("seq_id"), "idx", "bit")


SQL_BITS = f"""
bits AS (
  SELECT ROW_NUMBER() OVER (ORDER BY {", ".join(_LINE)}) - 1 AS idx, CAST(ROUND(l_extendedprice * 100) AS BIGINT) % 2 AS bit FROM lineitem
)"""
