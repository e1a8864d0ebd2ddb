"""Marts that grow by loads: equal to a full build after any split, repetition, correction or break."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.streaming import marts

FEEDS = {
    "sales": marts.Feed("day", {"price": ("max", "price")}, ("grade", "size"), "_price"),
    "herd": marts.Feed("seen", {"head": ("sum", "n"), "farms": ("count", "n"), "least": ("min", "n")}),
    "milk": marts.Feed("day", {"litres": ("sum", "n"), "top": ("max", "n")}, ("grade",)),
}
SCHEMAS = {"sales": "day timestamp, grade string, size string, price decimal(8,2)", "herd": "seen date, n long", "milk": "day date, grade string, n int"}
NAMES = {"sales": ("day", "grade", "size", "price"), "herd": ("seen", "n"), "milk": ("day", "grade", "n")}


def some_rows(seed, count, first=date(2023, 12, 20), days=60):
    """Rows of each feed, some without a date, key or value; new keys appear late."""
    import datetime
    from decimal import Decimal

    rng = random.Random(seed)
    out = defaultdict(list)
    for _ in range(count):
        day = rng.choice([None, *[first + timedelta(days=rng.randrange(days)) for _ in range(12)]])
        grade = rng.choice(["A", "B", None, "C d"])
        at = None if day is None else datetime.datetime(day.year, day.month, day.day, rng.randrange(24))
        out["sales"].append((at, grade, rng.choice(["x", "y", None]), rng.choice([None, Decimal(rng.randrange(10_000)) / 100])))
        out["herd"].append((day, rng.choice([None, rng.randrange(100)])))
        out["milk"].append((day, grade, rng.choice([None, rng.randrange(50)])))
    return out


def period(day, grain):
    if day is None:
        return None
    return {"daily": day, "weekly": day - timedelta(days=day.weekday()), "monthly": day.replace(day=1), "yearly": day.replace(month=1, day=1)}[grain]


def full_build(rows, grain):
    """{period: {column: value}} in plain Python, columns without a value left out."""
    cells = defaultdict(lambda: defaultdict(list))
    spine = set()
    for feed, spec in FEEDS.items():
        for row in rows.get(feed, ()):
            named = dict(zip(NAMES[feed], row, strict=True))
            day = named[spec.day]
            day = day.date() if hasattr(day, "hour") else day
            at = period(day, grain)
            spine.add(at)
            for m, (how, column) in spec.measures.items():
                name = m
                if spec.key:
                    key = "_".join(named[k] for k in spec.key if named[k] is not None)
                    name = f"{key}_{m}" if len(spec.measures) > 1 else f"{key}{spec.suffix}"
                cells[at][f"{feed}_{name}", how].append(named[column])
    out = {}
    for at in spine:
        found = {}
        for (name, how), values in cells[at].items():
            there = [v for v in values if v is not None]
            found[name] = len(there) if how == "count" else {"sum": sum, "max": max, "min": min}[how](there) if there else None
        out[at] = {k: v for k, v in found.items() if v is not None} if at is not None else {}
    return out


def as_found(mart, grain):
    return {r["ymd"]: {k: v for k, v in r.asDict().items() if k != "ymd" and v is not None} for r in mart.read(grain).collect()}


def frame(spark, feed, rows):
    return spark.createDataFrame(rows, SCHEMAS[feed])


def test_any_split_equals_a_full_build(spark, tmp_path):
    rows = some_rows(1, 240)
    rng = random.Random(2)
    mart = marts.GrowingMart(spark, f"file://{tmp_path}/mart", FEEDS)
    loads = []
    for feed, own in rows.items():
        dealt = [rng.randrange(3) for _ in own]
        loads += [(feed, k, [r for r, d in zip(own, dealt, strict=True) if d == k]) for k in range(3)]
    rng.shuffle(loads)
    seen = defaultdict(list)
    for at, (feed, batch, some) in enumerate(loads):
        assert mart.load(feed, batch, frame(spark, feed, some))
        seen[feed] += some
        if at == 4:
            assert set(mart.refresh()) == set(marts.GRAINS)
            assert as_found(mart, "weekly") == full_build(seen, "weekly")
    # a batch that is passed twice changes nothing, and there is nothing to do
    mart.refresh()
    feed, batch, some = loads[0]
    assert not mart.load(feed, batch, frame(spark, feed, some)) and mart.refresh() == {}
    for grain in marts.GRAINS:
        assert as_found(mart, grain) == full_build(rows, grain)
    assert mart.ledger().where("event = 'loaded'").agg(F.sum("rows")).first()[0] == 3 * 240


def test_only_touched_periods_are_computed(spark, tmp_path):
    mart = marts.GrowingMart(spark, f"file://{tmp_path}/mart", FEEDS, ("daily", "monthly"))
    rows = {"herd": [(date(2023, 11, 1) + timedelta(days=k), k) for k in range(100)]}
    mart.load("herd", 1, frame(spark, "herd", rows["herd"]))
    assert mart.refresh() == {"daily": 100, "monthly": 4}
    late = [(date(2024, 1, 3), 500), (date(2024, 1, 9), 1)]
    before = {f.rsplit("/", 2)[-2]: f for f in spark.read.parquet(f"{mart.root}/overall/daily").inputFiles()}
    mart.load("herd", 2, frame(spark, "herd", late))
    assert mart.refresh() == {"daily": 2, "monthly": 1}
    after = {f.rsplit("/", 2)[-2]: f for f in spark.read.parquet(f"{mart.root}/overall/daily").inputFiles()}
    assert {k for k in after if after[k] != before[k]} == {"bucket=2024"}
    assert as_found(mart, "daily") == full_build({"herd": rows["herd"] + late}, "daily")


def test_a_correction_takes_a_load_back(spark, tmp_path):
    mart = marts.GrowingMart(spark, f"file://{tmp_path}/mart", FEEDS, ("daily", "yearly"))
    day = date(2024, 5, 1)
    good, wrong = [(day, 5), (day + timedelta(days=1), 7)], [(day, 90), (date(2025, 3, 3), 1)]
    mart.load("herd", 1, frame(spark, "herd", good))
    mart.load("herd", 2, frame(spark, "herd", wrong))
    mart.refresh()
    assert mart.newest("herd") == date(2025, 3, 3)
    right = [(day, 6)]
    assert mart.load("herd", 2, frame(spark, "herd", right), correct=True)
    mart.refresh()
    for grain in ("daily", "yearly"):
        assert as_found(mart, grain) == full_build({"herd": good + right}, grain)  # the year 2025 is gone
    assert mart.newest("herd") == day + timedelta(days=1)
    # the wrong rows are kept in the raw layer
    assert spark.read.parquet(f"{mart.root}/raw/herd/batch=2/version=1").count() == 2
    mart.load("herd", 2, frame(spark, "herd", []), correct=True)
    mart.refresh()
    assert as_found(mart, "daily") == full_build({"herd": good}, "daily")


def test_a_load_that_breaks_off_is_not_seen(spark, tmp_path, monkeypatch):
    mart = marts.GrowingMart(spark, f"file://{tmp_path}/mart", FEEDS, ("daily",))
    rows = some_rows(3, 40)["milk"]
    mart.load("milk", 1, frame(spark, "milk", rows[:20]))
    mart.refresh()
    # raw rows and delta are written, the ledger is not
    with monkeypatch.context() as broken:
        broken.setattr(mart, "_note", lambda rows: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            mart.load("milk", 2, frame(spark, "milk", rows[20:] * 2))
    assert mart.refresh() == {} and as_found(mart, "daily") == full_build({"milk": rows[:20]}, "daily")
    assert mart.load("milk", 2, frame(spark, "milk", rows[20:]))
    # a mart is replaced, the ledger does not say so
    with monkeypatch.context() as broken:
        broken.setattr(mart, "_note", lambda rows: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            mart.refresh()
    assert mart.refresh()["daily"] > 0 and as_found(mart, "daily") == full_build({"milk": rows}, "daily")


def test_newer_rows_and_streams(spark, tmp_path):
    mart = marts.GrowingMart(spark, f"file://{tmp_path}/mart", FEEDS, ("daily", "monthly"))
    first, later = [(date(2024, 1, k), k) for k in (1, 2, 3)], [(date(2024, 1, k), k) for k in (3, 4, None or 5)] + [(None, 1)]
    assert mart.newest("herd") is None and mart.only_newer("herd", frame(spark, "herd", first)).count() == 3
    raw = f"file://{tmp_path}/files"
    frame(spark, "herd", first).write.parquet(raw)
    for wanted in (first, first + later):
        mart.follow("herd", raw, SCHEMAS["herd"], f"file://{tmp_path}/state").awaitTermination()
        assert as_found(mart, "monthly") == full_build({"herd": wanted}, "monthly")
        if wanted is first:
            assert sorted(mart.only_newer("herd", frame(spark, "herd", later)).collect()) == [(date(2024, 1, 4), 4), (date(2024, 1, 5), 5)]
            frame(spark, "herd", later).write.mode("append").parquet(raw)


def test_unmergeable_measures(spark):
    with pytest.raises(ValueError, match="avg"):
        marts.GrowingMart(spark, "file:///nowhere", {"a": marts.Feed("day", {"mean": ("avg", "x")})})
