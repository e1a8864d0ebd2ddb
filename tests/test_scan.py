"""Running values over groups of any size: scans by ranges against plain loops and plain windows."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quarry.operators import reconcile
from quarry.operators.prefix import Running, heavy_groups, parted, range_sorted, scan

SCHEMA = "g string, h int, o long, v long, d decimal(9,2), s string, r boolean"
VALUES = {
    "total": Running("sum", "v"), "seen": Running("count", "v"), "most": Running("max", "v"), "least": Running("min", "d"), "last": Running("last", "s"), "money": Running("sum", "d"),
    "most_since": Running("max", "v", "r"), "last_since": Running("last", "s", "r"), "total_since": Running("sum", "v", "r"), "seen_since": Running("count", "v", "r"),
}


def some_rows(seed, groups, resets):
    rng = random.Random(seed)
    rows = []
    for (g, h), n in groups.items():
        for o in range(n):
            v = rng.choice([None, None, rng.randrange(-50, 50)])
            rows.append((g, h, o, v, None if rng.random() < 0.3 else Decimal(rng.randrange(1000)) / 100, rng.choice([None, None, None, f"s{o}"]), rng.choices([None, False, True], [5, 5, resets])[0]))
    rng.shuffle(rows)
    return rows


def plain(rows):
    out, groups = [], {}
    for row in rows:
        groups.setdefault(row[:2], []).append(row)
    for own in groups.values():
        own.sort(key=lambda r: r[2])
        for k, row in enumerate(own):
            since = max((j for j in range(k + 1) if own[j][6]), default=0)
            found = []
            for v in VALUES.values():
                values = [r["ghovdsr".index(v.column)] for r in own[since if v.since else 0 : k + 1]]
                there = [x for x in values if x is not None]
                found.append(len(there) if v.how == "count" else (there[-1] if v.how == "last" else {"sum": sum, "max": max, "min": min}[v.how](there)) if there else None)
            out.append((*row, *found))
    return sorted(out, key=repr)


@pytest.mark.parametrize("resets", [0, 0.2, 5])
def test_scan_matches_plain_loops(spark, resets):
    rows = some_rows(7, {("hot", 1): 500, ("hot", None): 90, (None, 1): 200, ("a", 1): 1, ("b", 2): 3, **{(f"t{k}", k): 2 for k in range(40)}}, resets)
    df = spark.createDataFrame(rows, SCHEMA)
    found = scan(df, [F.col("o")], ["g", "h"], VALUES, partitions=13)
    assert found.columns == [*df.columns, *VALUES]
    assert found.schema["money"].dataType.scale == 2
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows)


def test_scan_without_groups_and_without_rows(spark):
    rows = some_rows(8, {("x", 1): 300}, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    found = scan(df, [F.col("o")], [], {"total": Running("sum", "v")}, partitions=9)
    assert sorted((r["o"], r["total"]) for r in found.collect()) == [(r[2], r[7]) for r in sorted(plain(rows), key=lambda r: r[2])]
    assert scan(df.limit(0), [F.col("o")], ["g"], VALUES).collect() == []


def test_one_group_is_many_ranges(spark):
    placed = range_sorted(spark.range(20_000).withColumn("g", F.lit(1)), [F.col("id")], ["g"], 16)
    sizes = [r["count"] for r in placed.groupBy(F.shiftright("place", 33)).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 20_000 / 16
    # equal rows are parted too
    placed = range_sorted(spark.range(20_000).select(F.lit(1).alias("g")), [F.col("g")], ["g"], 16)
    assert max(r["count"] for r in placed.groupBy(F.shiftright("place", 33)).count().collect()) < 3 * 20_000 / 16


def test_heavy_groups(spark):
    df = spark.createDataFrame([(None, 1)] * 5 + [("a", 1)] * 4 + [("b", None)] * 6, "g string, h int")
    assert heavy_groups(df, ["g", "h"], 6) is None
    heavy = heavy_groups(df, ["g", "h"], 4)
    rows, large = parted(df, ["g", "h"], heavy)
    assert rows.count() == 4 and large.groupBy("g", "h").count().count() == 2


def test_fills_are_equal_by_scans_and_by_windows(spark):
    rng = random.Random(3)
    schedule = []
    for entity in ["hot", "warm", None, *"abc"]:
        for _ in range({"hot": 900, "warm": 300}.get(entity, 6)):
            label = rng.choice([None, *[f"P{k}" for k in rng.sample(range(2, 400), 3)]])
            schedule.append(("b", entity, label, rng.choice([None, "c1", "c2", "c3"]), rng.choice(["type_a1", "type_a2", "type_b1", "other", None])))
    base = reconcile.base_schedule(spark.createDataFrame(schedule, "batch_id string, entity_id string, period_label string, category_code string, category_name string"))
    spine = reconcile.phase_spine(base, 400).union(base.where("entity_id = 'hot'").limit(3).withColumn("phase", F.lit(None).cast("int")).select(*reconcile.phase_spine(base).columns))
    spine = spine.cache()
    wanted = sorted(map(repr, reconcile.forward_fill(spine).collect()))
    for most in (0, 350):
        assert sorted(map(repr, reconcile.forward_fill(spine, heavy_groups(spine, reconcile.ENTITY, most)).collect())) == wanted
    whole = sorted(map(repr, reconcile.filled_spine(base, 400).collect()))
    assert sorted(map(repr, reconcile.filled_spine(base, 400, 500).collect())) == whole
    rows = spark.createDataFrame([(g, o, rng.choice([None, None, o])) for g in ("x", None) for o in [None, *range(300)]], "g string, o int, v int")
    wanted = sorted(map(repr, reconcile.last_known(rows, "v", ["g"], "o").collect()))
    assert sorted(map(repr, reconcile.last_known(rows, "v", ["g"], "o", 10).collect())) == wanted


def test_equal_rows_of_a_phase_go_through_the_scan_once(spark, monkeypatch):
    rows = [("b", 1, "P2", "c1", "type_a1")] * 9 + [("b", 1, "P4", None, "type_a2"), ("b", 2, None, "c2", "type_c"), (None, 1, "P3", "c3", "type_a1")]
    base = reconcile.base_schedule(spark.createDataFrame(rows, "batch_id string, entity_id long, period_label string, category_code string, category_name string"))
    wanted = sorted(map(repr, reconcile.filled_spine(base).collect()))
    scanned, scan = [], reconcile.scan
    monkeypatch.setattr(reconcile, "scan", lambda df, *how: scanned.append(df.count()) or scan(df, *how))
    monkeypatch.setattr(reconcile, "REPEATED", 4)
    found = reconcile.filled_spine(base, most=0)
    assert sorted(map(repr, found.collect())) == wanted and len(wanted) > scanned[0]
