import random
from collections import defaultdict

from pyspark.sql import functions as F

from repograph.llm import sharding
from repograph.llm.components import connected_components

SCHEMA = "doc_id long, text string, shard string, bits string, size long"


def shards(spark, rows, limit):
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)
    return sharding.assign_shards(df, F.col("doc_id"), F.octet_length("text"), limit, ["doc_id", "text"]).collect()


def check(rows, found, limit):
    key = lambda r: (repr(r[0]), repr(r[1]))
    assert sorted(((r.doc_id, r.text) for r in found), key=key) == sorted(rows, key=key)
    held = defaultdict(list)
    for r in found:
        assert r.depth == len(r.shard) and r.n_bytes == len((r.text or "").encode()) and r.oversized == (r.n_bytes > limit)
        held[r.shard].append(r.n_bytes)
    names = sorted(held)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    for name, sizes in held.items():
        assert sum(sizes) <= limit or len(sizes) == 1
        # A bucket was split only because it was too large.
        parent = [n for s, sizes in held.items() if name and s.startswith(name[:-1]) for n in sizes]
        assert not name or (sum(parent) > limit and len(parent) > 1)


def test_shards_fit_and_are_needed(spark):
    pick = random.Random(8)
    rows = [(i, "x" * pick.randint(0, 400)) for i in range(500)] + [(900, "y" * 9000), (None, "z"), (None, None), (901, None), (902, "")]
    for limit in (700, 5000, 10**9):
        check(rows, shards(spark, rows, limit), limit)


def test_a_key_with_most_rows_is_split(spark):
    rows = [(7, "x" * 50)] * 300 + [(i, "y" * 20) for i in range(20, 60)]
    found = shards(spark, rows, 500)
    check(rows, found, 500)
    assert max(r.depth for r in found) > sharding.KEY_BITS


def test_empty_table_and_files(spark, tmp_path):
    assert shards(spark, [], 10) == []
    df = spark.createDataFrame([(i, "x" * 30) for i in range(50)], "doc_id long, text string")
    found = sharding.assign_shards(df, F.col("doc_id"), F.octet_length("text"), 200, ["doc_id", "text"])
    sharding.write_shards(found, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50


def test_components_are_named_by_their_smallest_node(spark):
    pick = random.Random(5)
    nodes = list(range(400))
    edges = [(pick.choice(nodes), pick.choice(nodes)) for _ in range(260)]
    path = pick.sample(range(1000, 1300), 300)
    edges += list(zip(path, path[1:], strict=False)) + [(5000, i) for i in range(2000, 2100)] + [(1, 1), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {n: find(n) for n in root}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
