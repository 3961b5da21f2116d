import hashlib

import numpy as np

from repograph.llm import clusters

SCHEMA = "label int, v string, vec_id long, embedding array<float>, cluster int"


def brute(rows, k, rounds, size):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == size and all(x is not None and np.isfinite(np.float32(x)) for x in e):
            kept.append((i, [int(np.floor(1024 * float(np.float32(x)))) for x in e]))
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]
    if not centroids:
        return []
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for turn in range(rounds + 1):
        found = [min((far(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == n]
                if own:
                    centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = [sum(d for d, c in found if c == n) for n in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia), digests[c]) for (i, _), (d, c) in zip(kept, found, strict=True)), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(1, "x", i, e, 2) for i, e in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, clusters.cluster_vectors(df, **options).collect()), key=repr)


def vectors(seed, n, size):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(12, size))
    return [(int(i), (centres[pick.integers(12)] + pick.normal(size=size) * pick.choice([0.02, 0.5])).tolist()) for i in range(n)]


def test_as_computed_one_by_one(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(1, 200, 64)
    rows += [(900, rows[0][1]), (901, rows[0][1]), (0, rows[1][1]), (None, rows[2][1]), (902, [0.0] * 64), (903, [-0.0] * 64)]
    rows += [(910, None), (911, []), (912, [1.0] * 63), (913, [None] * 64), (914, [nan] + [0.0] * 63), (915, [inf] * 64)]
    rows += [(916, [-inf] * 64), (917, [1000.5] * 64)]
    assert run(spark, rows) == brute(rows, 8, 10, 64)


def test_ties_go_to_the_smaller_number(spark):
    # Points on a small grid have many equal distances.
    rows = [(i, [float(i % 3) / 1024, float(i // 3 % 3) / 1024]) for i in range(60)]
    assert run(spark, rows, k=5, size=2, rounds=4) == brute(rows, 5, 4, 2)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = vectors(2, 3, 64)
    assert run(spark, rows) == brute(rows, 8, 10, 64)
    assert run(spark, []) == [] and run(spark, [(None, rows[0][1])]) == []
    # Beyond the range in which distances are longs.
    assert run(spark, [(1, [3e38] * 64), (2, [2.0**18] * 64)]) == []


def test_bounds_save_distances_and_change_nothing():
    pick = np.random.default_rng(4)
    centroids = pick.integers(-3000, 3000, (8, 64))
    v = centroids[pick.integers(8, size=5000)] + pick.integers(-200, 200, (5000, 64))
    far = np.sqrt(np.stack([clusters._squares(v, p) for p in centroids], axis=1).astype(float))
    cluster, best, done = clusters.nearest(v, far, centroids + 5, centroids)
    exact = ((v[:, None] - (centroids + 5)) ** 2).sum(axis=2)
    assert (cluster == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert done < 1.5 * len(v)
