"""Centroid clustering: the annulus search against all comparisons, and the whole operator against plain rounds."""

import hashlib
import math

import numpy as np
import pytest

from quarry.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, label string, distance int, v int, cluster int, `a.b` int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, 3, 4) for i, v in rows], SCHEMA)


def plain(rows, count, rounds, width):
    """Every vector meets every centroid, in Python integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:count]]
    if not centroids:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for k in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    sums = [sum(d for d, c in found if c == k) for k in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sums[c], sum(sums), digests[c]) for (i, _), (d, c) in zip(kept, found, strict=True)), key=str)


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_annulus_finds_the_nearest_and_breaks_ties(spread):
    rng = np.random.default_rng(spread)
    for _ in range(20):
        vectors = rng.integers(-spread, spread + 1, (200, 5))
        centroids = rng.integers(-spread, spread + 1, (rng.integers(1, 24), 5))
        apart = np.square(vectors[:, None, :] - centroids[None]).sum(axis=2)
        for before in (None, rng.integers(0, len(centroids), 200), apart.argmin(axis=1)):
            label, best, _ = clusters.nearest(vectors, centroids, before)
            assert (label == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()


def test_annulus_leaves_most_pairs_out_where_norms_differ():
    rng = np.random.default_rng(5)
    centroids = (rng.normal(size=(200, 16)) * np.linspace(10, 10_000, 200)[:, None]).astype(np.int64)
    label = rng.integers(0, 200, 5_000)
    vectors = centroids[label] + rng.integers(-20, 21, (5_000, 16))
    _, _, compared = clusters.nearest(vectors, centroids, label)
    assert compared < 0.05 * 5_000 * 200


def test_largest_components_keep_exact_distances():
    edge = np.full((1, 64), clusters.MOST)
    _, best, _ = clusters.nearest(edge, -edge)
    assert int(best[0]) == 64 * (2 * clusters.MOST) ** 2 < 2**63


def test_rounds_match_plain_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 90, (rng.integers(-40, 41, 8) / 64 + rng.choice([0.0, 0.004])).tolist()) for k in range(120)]
    rows += [(200 + k, rows[0][1]) for k in range(60)]  # copies, a third of all
    rows += [(None, [0.25] * 8), (300, None), (301, [0.1] * 7), (302, [0.1] * 7 + [None]), (303, [float("nan")] + [0.0] * 7), (304, [float("inf")] + [0.0] * 7), (305, [])]
    found, _ = clusters.cluster_vectors(vectors_of(spark, rows), clusters=16, width=8)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows, 16, 3, 8)


def test_few_equal_and_no_vectors(spark):
    rows = [(k, [1.0, -0.01]) for k in range(5)]
    found, centroids = clusters.cluster_vectors(vectors_of(spark, rows), width=2)
    # equal centroids: the first takes all, the others stay as they were
    assert {tuple(r)[1:5] for r in found.collect()} == {(0, 0, 0, 0)} and centroids.tolist() == [[64, -1]] * 5
    for none in ([], [(None, [1.0, 1.0])], [(1, None)]):
        found, centroids = clusters.cluster_vectors(vectors_of(spark, none), width=2)
        assert found.collect() == [] and len(centroids) == 0 and found.columns[0] == "vec_id"


def test_beyond_range_is_passed_over(spark):
    found, _ = clusters.cluster_vectors(vectors_of(spark, [(1, [1e30, 0.0]), (2, [2.0**21, 0.0]), (3, [0.5, 0.5])]), width=2)
    assert sorted(r["vec_id"] for r in found.collect()) == [2, 3]


def test_query_matches_its_sql(spark, data, duck):
    from quarry.llm import queries

    found = sorted(map(tuple, queries.op13_clusters(spark, data).collect()))
    assert found == sorted(map(tuple, duck.sql(queries.ORACLES["op13_clusters"]).fetchall()))
