"""Centroid clustering of integer vectors, each round by an annulus search for the nearest centroid.

By the triangle inequality, a centroid nearer to a vector than a known distance u has a norm within u of the vector's. So
centroids are sorted by norm, each vector's distance to the centroid it had before is its u, and a binary search finds the range of
norms that can hold a nearer one; only those are compared, in exact integers. The range is closed and a little wider than u, so
centroids at equal distance are compared too, and ties go to the smaller number.

Vectors stay where they are: a round is one pass over them without a shuffle, and sums of components are partial aggregates of one row
for each centroid and component. Only these, whose number has a bound, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.runtime import arrow_batches, discard, materialize

CLUSTERS = 16
ROUNDS = 3
WIDTH = 64
SCALE = 64
#: Largest size of a component: squared distances of vectors of 64 such components fit in 64 bits.
MOST = 2**27
#: Vectors that a Python worker gets at once.
VECTORS_AT_ONCE = 4_000


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(id, v): vectors of exactly ``width`` components as integers floor(scale * x).

    Rows with a null vector, another width, a null or non-finite component, or one beyond ``MOST`` after scaling (whose distances 64 bits
    cannot hold) are passed over. Rows with null or repeated ids are kept, other columns are not.
    """
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall(x, lambda c: F.coalesce(F.abs(c) * scale <= MOST, F.lit(False)))
    return vectors.where((F.size(x) == width) & sound).select(F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))


def start_key(ident: Column, seed: int = 1) -> Column:
    """Order in which vectors become first centroids: SHA-256 of ``seed:id``."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), ident.cast("string")).cast("binary"), 256)


def nearest(vectors: np.ndarray, centroids: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid (ties: smaller number), and how many pairs were compared.

    ``before`` holds a centroid's number for each vector, whose distance is the first bound; without it that is the one with the nearest norm.
    """
    norms = np.sqrt(np.square(centroids).sum(axis=1).astype(np.float64))
    by_norm = np.argsort(norms, kind="stable")
    ranked = norms[by_norm]
    own = np.sqrt(np.square(vectors).sum(axis=1).astype(np.float64))
    if before is None:
        at = np.minimum(np.searchsorted(ranked, own), len(ranked) - 1)
        at -= (at > 0) & (own - ranked[np.maximum(at - 1, 0)] < ranked[at] - own)
        before = by_norm[at]
    label = before.astype(np.int32)
    best = np.square(vectors - centroids[label]).sum(axis=1)
    bound = np.sqrt(best.astype(np.float64))
    slack = 1e-9 * (1 + own + bound)
    low = np.searchsorted(ranked, own - bound - slack, "left")
    high = np.searchsorted(ranked, own + bound + slack, "right")
    compared = len(vectors)
    for place, number in enumerate(by_norm):
        rows = np.flatnonzero((low <= place) & (place < high) & (before != number))
        compared += len(rows)
        apart = np.square(vectors[rows] - centroids[number]).sum(axis=1)
        nearer = (apart < best[rows]) | ((apart == best[rows]) & (number < label[rows]))
        best[rows[nearer]], label[rows[nearer]] = apart[nearer], number
    return label, best, compared


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` (id, v, and label after the first time) with the label and distance under these centroids."""
    known = "label" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            vectors = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), -1)
            label, distance, _ = nearest(vectors, centroids, batch.column("label").to_numpy(zero_copy_only=False) if known else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), v, pa.array(label), pa.array(distance)], names=["id", "v", "label", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    with arrow_batches(rows.sparkSession, VECTORS_AT_ONCE):
        return materialize(rows.mapInArrow(run, f"id {kind}, v array<int>, label int, distance long"), "assigned")


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's vectors' componentwise floor(sum / count); one without vectors stays."""
    sums = rows.select("label", F.posexplode("v").alias("at", "x")).groupBy("label", "at").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    moved = centroids.copy()
    for row in sums.collect():  # a row for each centroid and component
        moved[row["label"], row["at"]] = row["s"] // row["n"]
    return moved


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    seed: int = 1,
) -> tuple[DataFrame, np.ndarray]:
    """(``id_col``, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector, and the final centroids.

    Vectors are those of :func:`integer_vectors`. First centroids are the ``clusters`` vectors with the least :func:`start_key` (of equal ids the
    least vector; null ids start none), all of them if there are fewer. Each round assigns every vector to the nearest centroid by squared Euclidean
    distance (ties: smaller number) and moves the centroids; then vectors are assigned once more. Inertia is the sum of distances, over
    the cluster and over all, null if 64 bits cannot hold it; centroid_sha256 is of the components in decimal, joined by commas. Repeated rows
    count and come out as often as they are there. No kept vector, or none with an id, gives no rows.
    """
    spark = vectors.sparkSession
    rows = materialize(integer_vectors(vectors, id_col, vector_col, width, scale), "vectors")
    first = rows.where("id is not null").select("v", start_key(F.col("id"), seed).alias("key")).orderBy("key", "v").limit(clusters)
    centroids = np.array([row["v"] for row in first.collect()], dtype=np.int64).reshape(-1, width)
    if not len(centroids):
        schema = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return rows.select(F.col("id").alias(id_col), *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", "))).limit(0), centroids
    for _ in range(rounds):
        after = _assigned(rows, centroids)
        centroids = _moved(after, centroids)
        discard(rows)
        rows = after
    after = _assigned(rows, centroids)
    discard(rows)
    inertia = {row["label"]: row["s"] for row in after.groupBy("label").agg(F.try_sum("distance").alias("s")).collect()}  # a row for each centroid
    total = sum(inertia.values()) if None not in inertia.values() else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = [(k, inertia.get(k), total if total is None or total < 2**63 else None, digest) for k, digest in enumerate(digests)]
    of = F.broadcast(spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    placed = after.select(F.col("id").alias(id_col), F.col("label").alias("cluster"), "distance").join(of, "cluster")
    return placed.select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
