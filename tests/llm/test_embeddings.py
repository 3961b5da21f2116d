import math

import numpy as np

from repograph.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, id long, n int, vector string"


def brute(rows, threshold=0.9):
    def usable(row):
        doc, v = row
        return doc is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    root = {doc: doc for doc, _ in rows if doc is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    arrays = [np.float32(v).astype(float) if usable((d, v)) else None for d, v in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = arrays[i], arrays[j]
            if a is not None and b is not None and len(a) == len(b):
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                    root[y] = x
    return sorted(((d, n, None if d is None else find(d), d is None or find(d) == d)
                   for (d, _), n in zip(rows, links, strict=True)), key=repr)


def result(spark, rows):
    df = spark.createDataFrame([(d, v, 1, 2, "x") for d, v in rows], SCHEMA)
    return sorted((tuple(r) for r in embeddings.near_vectors(df).collect()), key=repr)


def clusters(n, seed):
    pick = np.random.default_rng(seed)
    centers = pick.standard_normal((n // 8, 24))
    v = centers[pick.integers(0, len(centers), n)] + pick.standard_normal((n, 24)) * pick.choice([0.1, 0.25, 0.4], (n, 1))
    return [(int(i), [float(x) for x in row]) for i, row in enumerate(v)]


def test_matches_all_pairs(spark, monkeypatch):
    rows = clusters(400, 1)
    expected = brute(rows)
    assert result(spark, rows) == expected
    # Small blocks and buckets: hot buckets are split, more tables are used.
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "BUCKET", 16)
    monkeypatch.setattr(embeddings, "PAIRS", 50)
    assert result(spark, rows) == expected


def test_bad_vectors_copies_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [nan, 1.0]),
            (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [0.1, 1.0]),
            (12, [0.1, 1.0]), (13, [3e38, 3e38]), (14, [1e-30, 1e-30]), (0, [-1.0, 0.0])]
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_tables_reach_the_recall_that_is_planned():
    for classes in (10, 10**5, 10**9):
        bits, tables = embeddings.plan(classes, 0.9)
        same = (1 - math.acos(0.9) / math.pi) ** bits
        assert (1 - same) ** tables <= embeddings.MISS
