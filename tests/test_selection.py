"""Exact quantiles against sorted lists, whatever the distribution; fences against DuckDB in the catalogue."""

import math
import random

import pytest

from quarry.operators import selection

INF = float("inf")


def plain(groups, quantiles):
    out = []
    for key, values in groups.items():
        there = sorted(v for v in values if v is not None and not math.isnan(v))
        out += [(*key, q, len(there), there[max(1, math.ceil(len(there) * q)) - 1]) for q in quantiles if there]
    return sorted(out, key=repr)


@pytest.mark.parametrize("few", [150, 10_000])
def test_quantiles_match_sorted_lists(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    rng = random.Random(few)
    groups = {
        ("even", 1): [rng.random() for _ in range(700)], ("even", None): [rng.randrange(50) for _ in range(300)], (None, 1): [2.0 ** -rng.randrange(1000) for _ in range(200)],
        ("hot", 2): [7.0] * 900 + [rng.gauss(0, 1e6) for _ in range(90)], ("edges", 3): [INF] * 5 + [-INF] * 5 + [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, 1.0],
        ("one", 4): [3.5], ("none", 5): [None, None, float("nan")], ("nulls", 6): [None, 4.0, None, 5.0, float("nan")], ("infinite", 7): [INF, INF, -INF],
    }
    rows = [(g, h, float(v) if v is not None else None) for (g, h), own in groups.items() for v in own]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, h int, v double")
    quantiles = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    found = selection.exact_quantiles(df, "v", quantiles, ["g", "h"])
    assert found.columns == ["g", "h", "q", "n", "quantile"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(groups, quantiles)


def test_quantiles_of_all_rows_and_of_none(spark):
    values = [float(k * 7919 % 1009) for k in range(1009)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert sorted(map(tuple, selection.exact_quantiles(df, "v", (0.5, 0.9)).collect())) == plain({(): values}, (0.5, 0.9))
    assert selection.exact_quantiles(df.limit(0), "v", (0.5,)).collect() == []


def test_fences_do_not_move_with_outliers(spark):
    rows = [("a", float(k)) for k in range(100)] + [("a", 1e9), ("a", None), ("b", 5.0), (None, 1.0), (None, 2.0), (None, 90.0), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {(r["g"], r["v"]): (r["low"], r["high"]) for r in selection.beyond_fences(df, "v", ["g"]).collect()}
    assert set(found) == {("a", 1e9), (None, 90.0)} and found["a", 1e9] == (25.0 - 75.0, 75.0 + 75.0)
