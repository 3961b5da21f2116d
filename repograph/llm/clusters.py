"""Clustering around centroids with a table of pivot distances (LAESA).

A vector becomes whole numbers, and its squared distances to a few fixed pivots are stored with it once.  In a
round, the differences between a vector's and a centroid's distances to the pivots are lower bounds of their own
distance; only centroids whose bound does not exceed the best distance found so far get an exact one.  All
distances that decide are whole numbers, so the result does not depend on order or partitions.

Vectors are left out if their size is not the wanted one, if a component is null or not finite, or if a whole
number lies beyond ``LIMIT``, where squared distances would not fit a long.  Repeated rows are vectors of their
own.  Rows without an id belong to clusters but are no first centroids.  With fewer vectors than clusters, each
is a centroid; with none the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm import arrays
from repograph.llm.tables import store

SCALE = 1024
LIMIT = 1 << 27
#: Relative room for the rounding of square roots.
ROOM = 1e-9


def whole_vectors(vectors: DataFrame, size: int, column: str = "embedding") -> DataFrame:
    """(vec_id, v): components as whole numbers, floor(``SCALE`` x)."""

    wide = F.transform(column, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    fits = F.forall("v", lambda x: x.isNotNull() & F.abs(x).between(0, LIMIT))
    return (
        vectors.where(F.size(column) == size)
        .where(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE < 2.0 * LIMIT)))
        .select("vec_id", wide.alias("v")).where(fits).select("vec_id", F.col("v").cast("array<int>").alias("v")))


def first_centroids(vectors: DataFrame, k: int, salt: str = "3") -> np.ndarray:
    """The ``k`` vectors with the smallest hashes, in their order."""

    place = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id IS NOT NULL").orderBy(place, "v").limit(k).select("v").collect()
    return np.array([r[0] for r in rows], np.int64)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, size)


def _squares(v: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances."""

    apart = v - point
    return np.einsum("ij,ij->i", apart, apart)


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Vectors with their exact squared distances to the pivots, stored once."""

    size = pivots.shape[1]

    def run(batches):
        for batch in batches:
            v = _matrix(batch.column("v"), size)
            far = np.stack([_squares(v, p) for p in pivots], axis=1)
            lists = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * len(pivots), far.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], ["vec_id", "v", "far"])

    return store(vectors.mapInArrow(arrays.tidy(run), "vec_id long, v array<int>, far array<long>"))


def nearest(v: np.ndarray, far: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid (the first of equals), its squared distance, and how many were computed.

    ``far`` holds square roots of the vectors' distances to the pivots.
    """

    to_pivots = np.sqrt(np.array([_squares(pivots, c) for c in centroids], np.float64))
    bound = np.zeros((len(v), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(far[:, p, None] - to_pivots[:, p]), out=bound)
    # The square of a bound that is a little too small is still a bound.
    bound = (bound - ROOM * (far.max(axis=1, initial=0)[:, None] + to_pivots.max(axis=1, initial=0)) - ROOM).clip(0) ** 2
    likely = bound.argmin(axis=1)
    best, cluster, done = np.empty(len(v), np.int64), likely.copy(), len(v)
    for c in range(len(centroids)):
        own = likely == c
        best[own] = _squares(v[own], centroids[c])
    for c in range(len(centroids)):
        left = np.flatnonzero((likely != c) & (bound[:, c] <= best))
        exact = _squares(v[left], centroids[c])
        better = (exact < best[left]) | ((exact == best[left]) & (c < cluster[left]))
        best[left[better]], cluster[left[better]] = exact[better], c
        done += len(left)
    return cluster, best, done


def _assigned(centroids: np.ndarray, pivots: np.ndarray, report: Callable) -> Callable:
    size = pivots.shape[1]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"), size)
                far = np.sqrt(_matrix(batch.column("far"), len(pivots)).astype(np.float64))
                yield report(batch, v, *nearest(v, far, centroids, pivots))

    return arrays.tidy(run)


def _sums(batch: pa.RecordBatch, v: np.ndarray, cluster: np.ndarray, best: np.ndarray, done: int) -> pa.RecordBatch:
    """Counts and sums of a batch's clusters, one row for each component."""

    found = np.unique(cluster)
    sums = np.stack([v[cluster == c].sum(axis=0) for c in found])
    counts = np.bincount(cluster)[found]
    size = v.shape[1]
    return pa.RecordBatch.from_pydict({
        "cluster": pa.array(np.repeat(found, size), pa.int32()), "place": pa.array(np.tile(np.arange(size), len(found)), pa.int32()),
        "n": pa.array(np.repeat(counts, size), pa.int64()), "total": pa.array(sums.ravel(), pa.int64()),
        "distances": pa.array([done] + [0] * (sums.size - 1), pa.int64())})


def _rows(batch: pa.RecordBatch, v: np.ndarray, cluster: np.ndarray, best: np.ndarray, done: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "cluster", "distance"])


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, salt: str = "3") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    A round assigns every vector and moves each centroid that has vectors to the floor of their mean.
    """

    spark = vectors.sparkSession
    vectors = whole_vectors(vectors, size)
    result = "vec_id long, cluster int, distance long"
    centroids = first_centroids(vectors, k, salt)
    if not len(centroids):
        # Rows without an id make no centroids of their own, so they have none.
        return spark.createDataFrame([], f"{result}, cluster_inertia long, inertia long, centroid_sha256 string")
    pivots = centroids.copy()
    held = pivot_table(vectors, pivots)
    for _ in range(rounds):
        sums = held.mapInArrow(
            _assigned(centroids, pivots, _sums), "cluster int, place int, n long, total long, distances long")
        moved = centroids.copy()
        for c, place, n, total in sums.groupBy("cluster", "place").agg(
                F.sum("n"), F.sum(F.col("total").cast("decimal(38,0)"))).collect():
            moved[c, place] = int(total) // n
        if (moved == centroids).all():
            break  # all further rounds are the same
        centroids = moved
    found = store(held.mapInArrow(_assigned(centroids, pivots, _rows), result))
    by_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = by_cluster.agg(F.sum("cluster_inertia").alias("inertia"))
    named = spark.createDataFrame(
        [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())],
        "cluster int, centroid_sha256 string")
    # One row for each of the k clusters.
    extra = by_cluster.join(named, "cluster").crossJoin(inertia)
    return found.join(F.broadcast(extra), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
