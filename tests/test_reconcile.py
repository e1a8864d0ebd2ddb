"""Consistency check and phase comparison on small feeds worked out by hand."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from quarry.functions.columns import collapse_category, label_to_phase, snap_difference, version_filter
from quarry.operators import reconcile

A = "batch_id string, region_lv1 string, region_lv2 string, category string, metric_1 decimal(18,6), metric_2 decimal(18,6), metric_3 decimal(18,6), version_flag int"
B = "batch_id string, region_lv2 string, category_main string, category_sub string, metric_main decimal(18,6), metric_sub decimal(18,6), version_flag int"


def decimals(rows, first, last):
    return [tuple(D(str(v)) if first <= k <= last and v is not None else v for k, v in enumerate(r)) for r in rows]


@pytest.fixture
def feeds(spark):
    base, variant = "category_base_1", "category_variant_1"
    a = [("24XX", "R1", "d1", base, 10, 3, 2, 1), ("24XX", "R1", "d1", base, 5, 1, None, 1), ("24XX", "R1", "d1", variant, 4, 0, 1, 1), ("24XX", "R1", "d1", variant, 99, 9, 9, 2), ("24XX", "R2", "d1", base, 1, 1, 1, 1)]
    b = [("24XX", "d1", base, base, 15, 2, 3), ("24XX", "d1", base, base, 100, 100, 1), ("24XX", "d1", variant, "other", 7, 9, 3), (None, "d1", base, base, 50, 50, 1)]
    return spark.createDataFrame(decimals(a, 4, 6), A), spark.createDataFrame(decimals(b, 4, 5), B)


@pytest.mark.parametrize("how", [{}, {"equi": False}, {"stacked": True}])
def test_consistency_check(feeds, how):
    rows = [tuple(None if v is None else float(v) if isinstance(v, D) else v for v in r) for r in reconcile.consistency_check(*feeds, **how).collect()]
    base, variant = "category_base_1", "category_variant_1"
    wanted = [
        ("24XX", "d1", base, 15.0, 2.0, 17.0, 15.0, 2.0, 17.0, 0.0, 0.0, 0.0),
        ("24XX", "d1", base, 1.0, 1.0, 2.0, 15.0, 2.0, 17.0, -14.0, -1.0, -15.0),
        ("24XX", "d1", variant, 4.0, 1.0, 5.0, 15.0, 2.0, 17.0, -11.0, -1.0, -12.0),
        ("24XX", "d1", variant, 4.0, 1.0, 5.0, 7.0, None, 7.0, -3.0, 1.0, -2.0),
    ]
    assert sorted(rows, key=str) == sorted(wanted, key=str)
    assert [r[2] for r in rows] == [base, base, variant, variant]


def test_null_sums_tolerance_and_one_sided_keys(spark):
    a = spark.createDataFrame(decimals([("x1", "R", "d", "c", 1, 1, None, 1), ("x2", "R", "d", "c", 1, 1, 1, 1)], 4, 6), A)
    b = spark.createDataFrame(decimals([("x1", "d", "c", "c", 1, 1, 1), ("x3", "d", "c", "c", 1, 1, 1)], 4, 5), B)
    row = reconcile.consistency_check(a, b).collect()
    assert len(row) == 1 and row[0]["a_total_metric"] is None and row[0]["diff_total_metric"] == -2
    audit = reconcile.outer_audit(a, b.withColumnRenamed("category_main", "category"), ["batch_id", "region_lv2", "category"])
    assert sorted((r["batch_id"], r["side"]) for r in audit.collect()) == [("x2", "a"), ("x3", "b")]
    tiny = spark.createDataFrame([(D("0.0000000005"), D(0))], "a decimal(20,10), b decimal(20,10)")
    got = tiny.select(snap_difference(F.col("a"), F.col("b")).alias("s"), (F.col("a") - F.col("b")).alias("p")).first()
    assert got["s"] == 0 and got["p"] != 0


def test_alias_forms_agree_with_nulls(spark):
    cats = [None, "category_base_1", "category_variant_1", "category_variant_2", "category_base_2", "z"]
    a = spark.createDataFrame([(b, r, c, k) for k, c in enumerate(cats) for b in ("x", None) for r in ("d", None)], "batch_id string, region_lv2 string, category string, va int")
    b = spark.createDataFrame([(b, r, c, k) for k, c in enumerate(cats) for b in ("x", None) for r in ("d", None)], "batch_id string, region_lv2 string, category_main string, vb int")
    columns = ["batch_id", "region_lv2", "category", "category_main", "va", "vb"]
    forms = [sorted(map(str, f(a, b).select(*columns).collect())) for f in (reconcile.alias_join, reconcile.alias_join_or)]
    assert forms[0] == forms[1] and len(forms[0]) == 7


def test_equi_form_has_no_residual_and_versions_reach_the_scan(spark, data, feeds):
    plan = reconcile.alias_join(reconcile.source_a_totals(feeds[0]), reconcile.source_b_totals(feeds[1]))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    orders = spark.read.parquet(f"{data}/orders.parquet")
    kept = orders.where(version_filter(F.col("o_orderpriority"), F.col("o_custkey"), "OW"))
    assert "In(o_custkey, [1,3])" in kept._jdf.queryExecution().executedPlan().toString()


SCHEDULE = "batch_id string, entity_id string, period_label string, category_code string, category_name string"
STATUS = "batch_id string, entity_id string, region string, phase int, category_name string, status_flag string, value_current decimal(18,6)"
EXTERNAL = "batch_id string, region string, phase int, period_label string, category_name string, metric_value decimal(18,6)"


def phases(spark, schedule, status, external):
    return spark.createDataFrame(schedule, SCHEDULE), spark.createDataFrame(decimals(status, 6, 6), STATUS), spark.createDataFrame(decimals(external, 5, 5), EXTERNAL)


def test_phase_comparison(spark):
    schedule = [("b1", "e1", "P2", "c1", "type_a1"), ("b1", "e1", "P4", "c2", "type_a2")]
    status = [("b1", "e1", "r1", p, "type_a1", "on", v) for p, v in ((1, 10), (2, 8), (3, 5), (4, 5))]
    external = [("b1", "r1", p, f"P{2 if p < 3 else 4}", "type_a1" if p < 3 else "type_a2", v) for p, v in ((1, 10), (2, 7), (3, 5), (4, 5), (5, 1))]
    tables = phases(spark, schedule, status, external)
    filled = reconcile.forward_fill(reconcile.phase_spine(reconcile.base_schedule(tables[0]))).orderBy("phase").collect()
    assert [(r["phase"], r["grp"], r["category_code"], r["category_name"], r["period_label"]) for r in filled] == [(p, 1 if p < 3 else 2, "c1" if p < 3 else "c2", "type_a1" if p < 3 else "type_a2", "P2" if p < 3 else "P4") for p in range(1, 6)]
    rows = reconcile.phase_comparison(*tables).collect()
    columns = ("phase", "source_a_current", "source_a_delta", "source_b_current", "source_b_delta", "diff_current", "diff_delta")
    assert [tuple(r[c] for c in columns) for r in rows] == [(1, 10, None, 10, None, 0, 0), (2, 8, 2, 7, 3, 1, -1), (3, 5, None, 5, None, 0, 0), (4, 5, 0, 5, 0, 0, 0)]


def test_phase_edges(spark):
    schedule = [("b", "e", "P1", "c", "t"), ("b", "e", "P9", "c", "t"), ("b", "late", "P4", "c", "t"), ("b", "dup", "P2", "c1", "t1"), ("b", "dup", "P2", "c2", "t1"), ("b", "none", None, "c", "t")]
    base = reconcile.base_schedule(spark.createDataFrame(schedule, SCHEDULE))
    filled = reconcile.forward_fill(reconcile.phase_spine(base))
    rows = {}
    for r in filled.collect():
        rows.setdefault((r["entity_id"], r["phase"]), []).append(r["category_code"])
    assert all(rows["e", p] == [None] for p in range(1, 6))  # phases 0 and 8 never join
    assert [rows["late", p] for p in range(1, 6)] == [[None], [None], ["c"], ["c"], ["c"]]
    assert len(rows["dup", 1]) == 2 and not any(e == "none" for e, _ in rows)
    assert reconcile.duplicate_keys(base, ["entity_id", "period_label"]).count() == 1
    again = filled.drop("grp")
    assert sorted(map(str, reconcile.forward_fill(again).drop("grp").where("entity_id = 'late'").collect())) == sorted(map(str, again.where("entity_id = 'late'").collect()))


def test_null_phase_sorts_last_and_ties_are_ordered(spark):
    rows = [("b", "r", None, "P1", "t", 100), ("b", "r", 2, "P3", "t", 5), ("b", "r", 2, "P2", "t", 7), ("b", "r", 3, "P4", "t", 1)]
    totals = reconcile.phase_totals(spark.createDataFrame(decimals(rows, 5, 5), EXTERNAL), "metric_value").collect()
    assert {(r["phase"], r["period_label"]): r["delta_value"] for r in totals} == {(2, "P2"): None, (2, "P3"): 2, (3, "P4"): 4, (None, "P1"): -99}


def test_columns(spark):
    df = spark.createDataFrame([("P3", "a1"), ("P10", None), (None, "x")], "l string, c string")
    got = df.select(label_to_phase(F.col("l")).alias("p"), collapse_category(F.col("c"), {"a": ("a1", "a2")}).alias("g")).collect()
    assert [(r["p"], r["g"]) for r in got] == [(2, "a"), (9, None), (None, "x")]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("Px",)], "l string").select(label_to_phase(F.col("l"))).collect()


def test_reconcile_helper_and_last_known(spark):
    a = spark.createDataFrame([(1, D("1.0"), D("2.0")), (2, D("1.0"), None)], "k int, m decimal(20,12), n decimal(20,12)")
    b = spark.createDataFrame([(1, D("1.0000000001"), D("2.0000000001")), (3, None, None)], "k int, m decimal(20,12), n decimal(20,12)")
    rows = {r["k"]: r for r in reconcile.reconcile(a, b, ["k"], ["m", "n"], {"m": "1e-9"}, "full").collect()}
    assert rows[1]["diff_m"] == 0 and rows[1]["diff_n"] != 0 and rows[2]["diff_m"] == 1 and rows[3]["diff_n"] == 0
    s = spark.createDataFrame([(1, 1, 5), (1, 2, None), (1, 3, 7), (2, 1, None)], "g int, o int, v int")
    assert [r["v"] for r in reconcile.last_known(s, "v", ["g"], "o").orderBy("g", "o").collect()] == [5, 5, 7, None]
