"""Marts, periods, layered storage, sources and incremental refresh."""

import io
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from quarry.operators import checks, mart
from quarry.sources import files
from quarry.streaming.refresh import refresh

PRICE = "ymd date, species string, item string, grade string, trade_type string, price double"


@pytest.fixture
def prices(spark):
    day = date(2026, 9, 1)
    return spark.createDataFrame([(day, "소", "안심", "1등급", "일반", 100.0), (day, "소", "안심", "1등급", "특수", 120.0), (day, "돼지", "목심", "1등급", "일반", 90.0), (date(2026, 9, 2), "소", "등심", None, "일반", 80.0)], PRICE)


def test_pivots_and_round_trip(prices):
    wide = mart.pivot_static(prices.where("species = '소'"), ["ymd"], F.col("trade_type"), ["일반", "특수"], "price", "_가격").orderBy("ymd").collect()
    assert [r.asDict() for r in wide] == [{"ymd": date(2026, 9, 1), "일반_가격": 100.0, "특수_가격": 120.0}, {"ymd": date(2026, 9, 2), "일반_가격": 80.0, "특수_가격": None}]
    dynamic = mart.dynamic_pivot(prices, ["ymd"], mart.composite_key("species", "item", "grade"), "price")
    assert dynamic.columns == ["ymd", "돼지_목심_1등급", "소_등심", "소_안심_1등급"]
    cells = {(r["ymd"].day, r["pivot_key"]): r["value"] for r in mart.unpivot(dynamic, ["ymd"]).collect()}
    assert cells == {(1, "돼지_목심_1등급"): 90.0, (1, "소_안심_1등급"): 120.0, (2, "소_등심"): 80.0}
    with pytest.raises(ValueError):
        mart.pivot_values(prices, F.col("item"), most=1)


def test_date_spine_and_lookup(spark):
    x = spark.createDataFrame([(date(2026, 1, 1), 1.0), (date(2026, 1, 2), 2.0)], "ymd date, v double")
    y = spark.createDataFrame([(date(2026, 1, 2), 3.0), (date(2026, 1, 3), 4.0)], "ymd date, v double")
    rows = [tuple(r) for r in mart.date_spine({"x": x, "y": y}).orderBy("ymd").collect()]
    assert [r[1:] for r in rows] == [(1.0, None), (2.0, 3.0), (None, 4.0)]
    named = mart.code_lookup(x, spark.createDataFrame([(1.0, "one")], "code double, name string"), "v").orderBy("ymd").collect()
    assert [r["v_name"] for r in named] == ["one", None]
    weekly = mart.at_grain(x.union(y), "weekly", "ymd", {"v": "max"}).collect()
    assert [(r["ymd"], r["v"]) for r in weekly] == [(date(2025, 12, 29), 4.0)]


def test_normal_year(spark):
    df = spark.createDataFrame([("a", date(y, 5, d), v) for y, d, v in ((2020, 1, 10), (2020, 2, 20), (2021, 1, 50), (2022, 1, 70))], "k string, day date, v long")
    rows = {r["year"]: (r["value"], r["normal_value"]) for r in mart.normal_year(df, ["k"], "day", "v").collect()}
    assert rows == {2020: (30, 60.0), 2021: (50, 50.0), 2022: (70, 40.0)}
    current = spark.createDataFrame([(1, 5.0), (2, 6.0)], "k int, price double")
    assert [r["normal_price"] for r in mart.with_normal(current, current.where("k = 1"), ["k"]).orderBy("k").collect()] == [5.0, None]


def test_month_windows(spark):
    assert mart.month_window(date(2024, 3, 31)) == (date(2024, 2, 1), date(2024, 2, 29))
    assert mart.month_window(date(2024, 1, 1)) == (date(2023, 12, 1), date(2023, 12, 31))
    assert mart.month_window(date(2024, 1, 15), 13) == (date(2022, 12, 1), date(2022, 12, 31))
    row = spark.createDataFrame([(date(2024, 3, 31),)], "d date").select(*(c.alias(n) for n, c in mart.month_ends(F.col("d")).items())).first()
    assert tuple(row) == (date(2024, 3, 31), date(2024, 2, 29), "20240331")


def test_period_filter_reaches_the_scan(spark, data):
    kept = mart.in_period(spark.read.parquet(f"{data}/orders.parquet"), "o_orderdate", "1996-02-01", "1996-02-29")
    assert "GreaterThanOrEqual(o_orderdate" in kept._jdf.queryExecution().executedPlan().toString()


def test_cleaning(spark):
    rows = [("2024-02-01", "a", "1,000", "2.5"), ("2024-02-30", "a", "1", "1"), ("2024-02-10", "  ", "1", "1"), ("2024-03-01", "a", "1", "1"), ("2024-02-29", "b", "x", "3"), (None, "a", "1", "1")]
    df = spark.createDataFrame(rows, "ymd string, item string, qty string, price string")
    got = checks.clean(df, ["ymd", "item"], {"ymd": "yyyy-MM-dd"}, {"qty": "int", "price": "double"}, ("ymd", date(2024, 2, 1), date(2024, 2, 29)), ["ymd", "item", "qty"])
    assert sorted(map(tuple, got.collect())) == [(date(2024, 2, 1), "a", 1000), (date(2024, 2, 29), "b", None)]
    with pytest.raises(ValueError, match="weight"):
        checks.require_columns(df, ["item", "weight"])


def test_load_checks(spark):
    df = spark.createDataFrame([("b1", "x", date(2024, 1, 1)), ("b1", "x", date(2024, 1, 2)), ("b2", "x", date(2024, 1, 3)), ("b2", "y", None)], "batch string, item string, day date")
    codes = spark.createDataFrame([("x",), ("y",)], "item string")
    assert [r["batch"] for r in checks.constant_loads(df, "batch", "item", codes).collect()] == ["b1"]
    assert checks.constant_loads(df, "batch", "item", codes.where("item = 'x'")).count() == 0
    report = {r["check"]: r["passed"] for r in checks.load_report(df, ["batch", "gone"], "day", date(2024, 1, 1), date(2024, 1, 2)).collect()}
    assert report == {"rows_present": True, "columns_present": False, "dates_valid": False, "within_period": False, "newest_day": True}
    assert checks.is_newer(df.where("batch = 'b1'"), df, "day") and not checks.is_newer(df, df, "day") and checks.is_newer(df.limit(0), df, "day")
    values = spark.createDataFrame([(k, float(k % 5)) for k in range(100)] + [(100, 500.0)], "k int, v double")
    assert [r["k"] for r in checks.outliers(values, "v").collect()] == [100]
    assert {r["column"]: r["nulls"] for r in checks.null_counts(df, ["batch", "day"]).collect()} == {"batch": 0, "day": 1}


def test_zip_and_csv(spark, tmp_path):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a/prices.csv", "item,qty\r\nx,1\r\n\r\ny,2\r\n")
        z.writestr("notes.txt", "no")
    (tmp_path / "one.zip").write_bytes(packed.getvalue())
    members = files.unzip(spark, f"file://{tmp_path}/*.zip", ".csv")
    assert [r["member"] for r in members.collect()] == ["a/prices.csv"]
    assert sorted((r["item"], r["qty"]) for r in files.csv_rows(members, "item string, qty int").collect()) == [("x", 1), ("y", 2)]
    with pytest.raises(Exception, match="bytes"):
        files.unzip(spark, f"file://{tmp_path}/*.zip", "", most_bytes=3).collect()


def test_layers_and_vector_records(spark, tmp_path):
    store = files.LayeredStore(spark, f"file://{tmp_path}")
    day = spark.createDataFrame([(1, "a"), (2, "b")], "v int, part string")
    store.write(day, "raw", "t")
    store.write(day, "raw", "t")
    assert store.read("raw", "t").count() == 4
    store.write(day, "pivot", "t", ["part"])
    store.write(spark.createDataFrame([(9, "b")], "v int, part string"), "pivot", "t", ["part"])
    assert sorted((r["v"], r["part"]) for r in store.read("pivot", "t").collect()) == [(1, "a"), (9, "b")]
    with pytest.raises(ValueError):
        store.path("gold", "t")
    record = day.select(*files.vector_record(F.col("v"), F.array(F.lit(1.0)), F.lit(2024), F.lit(5), F.col("part"), F.col("part")))
    assert record.schema.simpleString() == "struct<id:string,vector:array<float>,metadata:struct<year:int,month:int,item:string>,document:string>"
    newer = record.where("id = '2'").withColumn("document", F.lit("new")).union(record.where("id = '2'").withColumn("id", F.lit("3")))
    merged = {r["id"]: r["document"] for r in files.upsert_records(record, newer).collect()}
    assert merged == {"1": "a", "2": "new", "3": "b"}
    files.write_result(day, f"file://{tmp_path}/out.csv")
    assert files.read_table(spark, f"file://{tmp_path}/out.csv").count() == 2
    assert files.json_fields(spark.createDataFrame([('{"k": 1}',), ("bad",)], "j string"), "j", "k int").select("k").collect() == [(1,), (None,)]


def test_refresh_sees_each_file_once(spark, tmp_path):
    raw, seen = f"file://{tmp_path}/raw", []
    for value in (1, 2):
        spark.createDataFrame([(value,)], "v int").coalesce(1).write.mode("append").parquet(raw)
        query = refresh(spark, raw, "v int", f"file://{tmp_path}/state", lambda batch, n: seen.extend(r["v"] for r in batch.collect()))
        query.awaitTermination(60)
    assert seen == [1, 2]
