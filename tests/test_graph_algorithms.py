"""Joins against plain loops on random graphs."""

import hashlib
import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from repograph.operators import diff, digest, paths, scc
from repograph.session import KEYS

NODE = (
    "repository_id string, revision_id string, id string, kind string, language string, path string, "
    "qualified_name string, signature string, body_fingerprint string"
)


def score(a, b):
    if a["kind"] != b["kind"] or a["language"] != b["language"]:
        return 0.0
    total = 0.0
    if a["body_fingerprint"] and a["body_fingerprint"] == b["body_fingerprint"]:
        total += 0.65
    if a["path"] == b["path"]:
        total += 0.15
    shape = lambda n: n["signature"] and "function" + n["signature"][n["signature"].index("("):]
    if shape(a) and shape(a) == shape(b):
        total += 0.15
    owner = lambda n: n["qualified_name"].rpartition(".")[0]
    if owner(a) and owner(a) == owner(b):
        total += 0.05
    return min(total, 1.0)


def brute_renames(removed, added, threshold):
    pairs = {(a["id"], b["id"]): score(a, b) for a in removed for b in added}
    good = {k: s for k, s in pairs.items() if s >= threshold}
    out = set()
    for (x, y), s in good.items():
        left = [t for (p, _), t in good.items() if p == x]
        right = [t for (_, q), t in good.items() if q == y]
        if s == max(left) == max(right) and left.count(s) == 1 and right.count(s) == 1:
            out.add((x, y, s))
    return out


def test_renames_equal_the_pairwise_rule(spark):
    rng = random.Random(5)
    for threshold in (0.8, 0.3, 0.0):
        sides, rows = [], []
        for side in ("b", "a"):
            nodes = [{
                "id": f"{side}{i}", "kind": rng.choice(["FUNCTION", "FUNCTION", "METHOD"]), "language": rng.choice(["python", None]),
                "path": rng.choice(["p", "q", "r"]), "qualified_name": rng.choice(["m.x", "n.y", "z"]),
                "signature": rng.choice(["f(a)", "g(a)", "h(b)", None]),
                "body_fingerprint": rng.choice(["1", "2", "3", "4", "5", None])} for i in range(14)]
            sides.append(nodes)
            rows.append(spark.createDataFrame([("r", "v", n["id"], n["kind"], n["language"], n["path"], n["qualified_name"], n["signature"], n["body_fingerprint"]) for n in nodes], NODE))
        got = {(r.before_node_id, r.after_node_id, r.score) for r in diff.match_renames(rows[0], rows[1], threshold).collect()}
        assert got == brute_renames(sides[0], sides[1], threshold)


def components(edges):
    nodes = {n for e in edges for n in e}
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)

    def reach(start):
        seen, todo = set(), [start]
        while todo:
            for nxt in out[todo.pop()] - seen:
                seen.add(nxt)
                todo.append(nxt)
        return seen

    far = {n: reach(n) for n in nodes}
    found = {tuple(sorted({m for m in nodes if m in far[n] and n in far[m]} | {n})) for n in nodes}
    return {c for c in found if len(c) > 1}


def test_cycles_equal_reachability(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for repo in ("x", "y", "z"):
        size = rng.randint(8, 30)
        edges = {(f"n{rng.randrange(size):02d}", f"n{rng.randrange(size):02d}") for _ in range(int(size * 1.3))}
        want[repo] = components({e for e in edges if e[0] != e[1]})
        rows += [(repo, "r", a, b, "CALLS", "exact") for a, b in edges]
    rows.append(("x", "r", "n00", "zz", "CALLS", "inferred"))
    rows.append(("x", "r", "zz", "n00", "CALLS", "exact"))
    table = spark.createDataFrame(rows, "repository_id string, revision_id string, source_id string, target_id string, predicate string, quality string")
    found = defaultdict(lambda: defaultdict(set))
    for r in scc.cycles(table).collect():
        found[r.repository_id][r.cycle_id].add(r.member)
    for repo, sets in want.items():
        assert {tuple(sorted(m)) for m in found[repo].values()} == sets
        assert all(c == min(m) for c, m in found[repo].items())


RANK = ["CALLS", "INVOKES", "DISPATCHES_TO", "INSTANTIATES", "HANDLES", "IMPORTS"]


def bfs(edges, anchor, max_hops):
    """First path to each node of a queue with sorted neighbours."""

    out = defaultdict(list)
    for e in edges:
        out[e[0]].append(e)
    for e in out.values():
        e.sort(key=lambda x: (RANK.index(x[2]), x[1], x[3], x[4]))
    paths_to, queue = {anchor: []}, deque([anchor])
    while queue:
        node = queue.popleft()
        if len(paths_to[node]) >= max_hops:
            continue
        for e in out[node]:
            if e[1] not in paths_to:
                paths_to[e[1]] = [*paths_to[node], e[4]]
                queue.append(e[1])
    return {n: p for n, p in paths_to.items() if p}


def test_paths_equal_a_queue(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for q in ("q1", "q2", "q3", "q4"):
        size = rng.randint(5, 12)
        edges = []
        for i in range(size * 3):
            a, b = rng.randrange(size), rng.randrange(size)
            if a != b:
                edges.append((f"n{a}", f"n{b}", rng.choice(RANK), rng.choice(["r1", "r2"]), i))
        rows += [(q, *e) for e in edges]
        want.update({(q, "n0", n): p for n, p in bfs(edges, "n0", 3).items()})
    table = spark.createDataFrame(rows, "question_id string, source string, target string, predicate string, relation_id string, order_no int")
    anchors = table.select("question_id").distinct().withColumn("anchor", F.lit("n0"))
    got = {
        (r.question_id, r.anchor, r.node): [s.order_no for s in r.path]
        for r in paths.reach_paths(table, anchors, ["question_id"], 3).collect()}
    assert got == want
    pairs = spark.createDataFrame([(k[0], k[1], k[2]) for k in want][::2], "question_id string, anchor string, target string")
    some = paths.shortest_paths(table, pairs, ["question_id"], 3, RANK).collect()
    assert {(r.question_id, r.anchor, r.target): r.hops for r in some} == {k: len(want[k]) for k in list(want)[::2]}


def test_connectivity(spark):
    edges = spark.createDataFrame([("l1", "a", "b"), ("l1", "c", "b"), ("l2", "a", "b")], "lens_id string, source string, target string")
    members = spark.createDataFrame([("l1", x) for x in "abc"] + [("l2", x) for x in "abd"], "lens_id string, node string")
    got = {r.lens_id: r.connected for r in paths.is_connected(edges, members, ["lens_id"]).collect()}
    assert got == {"l1": True, "l2": False}


def test_linear_and_tree_digests(spark):
    rows = [(k, f"p{i:04d}", hashlib.sha256(f"{k}{i}".encode()).hexdigest()) for k in ("a", "b") for i in range(200)]
    table = spark.createDataFrame(rows, "repository_id string, path string, content_hash string")
    got = {r.repository_id: r.revision_id for r in digest.content_revision(table, digest.linear_digest).collect()}
    for key in ("a", "b"):
        full = hashlib.sha256()
        for k, path, value in rows:
            if k == key:
                full.update(len(path).to_bytes(4, "big") + path.encode() + bytes.fromhex(value))
        assert got[key] == f"content:{full.hexdigest()}"
    tree = {tuple(r) for r in digest.content_revision(table).collect()}
    assert {tuple(r) for r in digest.content_revision(table.repartition(7)).collect()} == tree
    changed = table.withColumn("content_hash", F.when(F.col("path") == "p0007", F.sha2(F.lit("x"), 256)).otherwise(F.col("content_hash")))
    assert not tree & {tuple(r) for r in digest.content_revision(changed).collect()}


def test_linear_digest_streams_its_groups(spark):
    rows = [(k, i % 50, f"{i:04x}") for k in ("a", None, "b") for i in range(300)] + [("c", 1, None), ("d", 2, "zz"), ("d", 3, "00"), ("e", 1, "ab"), ("e", None, "cd"), ("e", 0, None)]
    table = spark.createDataFrame(rows, "owner string, place int, body string").repartition(5)
    found = digest.linear_digest(table, ["owner"], ["place"], "body")
    assert "collect_list" not in found._jdf.queryExecution().toString()
    each = hashlib.sha256(bytes.fromhex("".join(sorted((r[2] for r in rows if r[0] == "a"), key=lambda x: (int(x, 16) % 50, x)))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.owner: r.digest for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {**dict.fromkeys(("a", "b", None), each.hexdigest()), "c": hashlib.sha256().hexdigest(), "d": None,
                   "e": hashlib.sha256(bytes.fromhex("cdab")).hexdigest()}


def test_new_cycles_compare_member_sets(spark):
    rows = lambda *sets: spark.createDataFrame(
        [("r", "v", min(s), m) for s in sets for m in s], "repository_id string, revision_id string, cycle_id string, member string")
    before = rows("ab", "cde", "xy")
    after = rows("ab", "cd", "xyz", "mn")
    assert {r.cycle_id for r in scc.new_cycles(before, after).collect()} == {"c", "x", "m"}
    assert KEYS == ["repository_id", "revision_id"]


def _random_graph(seed, nodes, edges):
    pick = random.Random(seed)
    rows = [(f"n{pick.randrange(nodes):04d}", f"n{pick.randrange(nodes):04d}") for _ in range(edges)]
    # Chains, a ring, a chain back to its head, two ways between the same nodes.
    rows += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("c060", "n0001"), ("n0001", "c000")]
    rows += [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)]
    rows += [("n0002", "x1"), ("x1", "x2"), ("x2", "n0002"), ("n0003", "y1"), ("y1", "n0004"), ("n0003", "z1"), ("z1", "n0004")]
    rows += [("t0", "t1"), ("t1", "t2"), ("t2", "t3"), ("l1", "l2"), ("l2", "l1"), ("l1", "l3"), ("l3", "l1")]
    return rows


def _expected(rows):
    import numpy as np

    names = sorted({x for r in rows for x in r})
    number = {n: i for i, n in enumerate(names)}
    reach = np.eye(len(names), dtype=bool)
    for a, b in rows:
        reach[number[a], number[b]] = True
    for k in range(len(names)):
        reach |= reach[:, k:k + 1] & reach[k]
    both = reach & reach.T
    return {(names[int(np.argmax(both[i]))], names[i]) for i in range(len(names)) if both[i].sum() > 1}


def test_cycles_of_graphs_that_fit_no_task(spark, monkeypatch):
    rows = _random_graph(3, 120, 150)
    table = spark.createDataFrame(
        [("r", rev, a, b, "CALLS", "exact") for rev in ("v1", "v2") for a, b in (rows if rev == "v1" else rows[:100])],
        "repository_id string, revision_id string, source_id string, target_id string, predicate string, quality string")
    want = {("v1", *x) for x in _expected(rows)} | {("v2", *x) for x in _expected(rows[:100])}
    for size in (500_000, 40, 5, 1):
        monkeypatch.setattr(scc, "BLOCK_EDGES", size)
        assert {(r.revision_id, r.cycle_id, r.member) for r in scc.cycles(table).collect()} == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rows = spark.range(100_000).selectExpr(
        "'r' AS repository_id", "'v' AS revision_id", "format_string('n%06d', id) AS source_id",
        "format_string('n%06d', IF(id = 99999, 10, id + 1)) AS target_id", "'CALLS' AS predicate", "'exact' AS quality")
    for size in (500_000, 1000):
        monkeypatch.setattr(scc, "BLOCK_EDGES", size)
        rounds = []
        monkeypatch.setattr(scc, "cut", lambda df, keep=scc.cut: rounds.append(1) or keep(df))
        found = scc.cycles(rows).agg(F.count("member"), F.countDistinct("cycle_id"), F.min("cycle_id")).head()
        assert tuple(found) == (99_990, 1, "n000010")
        # Doublings, and a fixed number of other tables.
        assert len(rounds) <= 20 + 17
        monkeypatch.undo()
