import datetime
import hashlib

from pyspark.sql import functions as F

from repograph.functions import ids
from repograph.operators import diff, entrypoints, evolution, paths
from repograph.sources import graph, records
from repograph.streaming import events as streaming

EDGE = ("repository_id string, revision_id string, id string, source_id string, target_id string, predicate string, "
        "quality string")


def test_root_fingerprints(spark):
    df = spark.createDataFrame([("/a/b/",), ("/",), ("//",), ("C:\\x\\",), ("rel",)], "path string")
    found = [r[0] for r in df.select(ids.root_fingerprint(F.col("path"))).collect()]
    assert found == [hashlib.sha256(p.encode()).hexdigest() for p in ("/a/b", "/", "/", "C:/x", "rel")]


def test_origin_locations(spark):
    known = {
        "https://user:pw@Host.com:443/a/b.git/": "host.com/a/b", "ssh://git@host.com:2222/a/b": "host.com:2222/a/b",
        "git@host.com:a/b.git": "host.com/a/b", "host:repo": "host/repo", "C:/x/y": None, "D:\\x": None, "plain": None,
        "ftp://host/a": None, "https://host/../a": None, "https://host": None, "https://host/a%20b?x#y": "host/a b",
        "https://host/a?b": "host/a", "https://ho st/a": None, "https://host:80x/a": None, "/local/path": None}
    df = spark.createDataFrame([(k,) for k in known], "origin string")
    assert {r.origin: r.place for r in df.withColumn("place", ids.origin_location(F.col("origin"))).collect()} == known


def test_observations_and_summary(spark, tmp_path):
    metrics = {c: 1 for c in records.SUMMARY if c not in ("mode", "status", "node_hits", "latency_ms")}
    row = {**metrics, "question_id": "q1", "condition": "A", "run_id": "r", "required_node_hits": 2, "latency_ms": 12.3456}
    table = spark.createDataFrame([row])
    runs = spark.createDataFrame([("r", "q1", "A", "live", "ready")], "run_id string, question_id string, condition string, mode string, status string")
    records.write_summary(table, runs, str(tmp_path / "summary"))
    written = spark.read.option("header", True).csv(str(tmp_path / "summary"))
    assert written.columns == records.SUMMARY and written.first().latency_ms == "12.346" and written.first().node_hits == "2"
    records.write_observations({"runs": runs}, str(tmp_path / "seen"))
    assert records.read_observations(spark, str(tmp_path / "seen"), {"runs": runs})["runs"].collect() == runs.collect()


def test_a_stored_delta_must_have_all_tables(spark):
    row = spark.createDataFrame([("repo", "n1")], "repository_id string, id string")
    fresh = {"added_nodes": row, "removed_nodes": row, "nodes": row}
    problems = lambda given: {(r.record, r.problem) for r in diff.verify_delta(given, fresh).collect()}
    assert problems(fresh) == set()
    assert problems({"added_nodes": row}) == {("removed_nodes", "missing")}
    assert problems({**fresh, "other": row}) == {("other", "not in comparison")}
    assert problems({**fresh, "added_nodes": row.limit(0)}) == {("added_nodes", "missing")}


def test_a_revision_written_again_replaces_itself(spark, tmp_path):
    nodes = lambda rev, names: spark.createDataFrame([("r", rev, n) for n in names], "repository_id string, revision_id string, id string")
    edges = spark.createDataFrame([], EDGE)
    root = str(tmp_path / "graph")
    graph.write_graph(nodes("v1", "ab"), edges, root)
    graph.write_graph(nodes("v2", "abc"), edges, root)
    graph.write_graph(nodes("v1", "a"), edges, root)
    stored = spark.read.parquet(f"{root}/nodes")
    assert {(r.revision_id, r.id) for r in stored.collect()} == {("v1", "a"), ("v2", "a"), ("v2", "b"), ("v2", "c")}
    assert spark.read.parquet(f"{root}/hashes").count() == 2


def test_a_revision_written_again_without_edges_keeps_none(spark, tmp_path):
    nodes = spark.createDataFrame([("r:1/a", v, n) for v in ("v1", "v2") for n in "ab"], "repository_id string, revision_id string, id string")
    edges = spark.createDataFrame([("r:1/a", v, f"e{v}", "a", "b", "CALLS", "exact") for v in ("v1", "v2")], EDGE)
    root = str(tmp_path / "graph")
    graph.write_graph(nodes, edges, root)
    graph.write_graph(nodes.where("revision_id = 'v1'"), edges.limit(0), root)
    assert [(r.repository_id, r.revision_id) for r in spark.read.parquet(f"{root}/edges").collect()] == [("r:1/a", "v2")]
    assert spark.read.parquet(f"{root}/nodes").count() == 4 and spark.read.parquet(f"{root}/hashes").count() == 2


def test_dockerfile_instructions():
    source = "FROM x\n# CMD no \\\nCMD [\"python\", \\\n  \"a.py\"]\nRUN b \\\n  CMD c\nENTRYPOINT sh \\  \n -c d.py\ncmd [bad\nCMD 'open"
    assert list(entrypoints.dockerfile_references(source)) == [
        ("container-cmd", "python", 3), ("container-cmd", "a.py", 3), ("container-entrypoint", "sh", 7),
        ("container-entrypoint", "-c", 7), ("container-entrypoint", "d.py", 7)]


def test_events_of_any_size_are_ready(spark):
    facts = spark.createDataFrame([("r", "a", "b", str(i)) for i in range(120)],
                                  "repository_id string, before_revision_id string, after_revision_id string, fact_id string")
    assert evolution.change_events(facts).first().status == "ready"
    assert evolution.change_events(facts, max_facts=49).first().status == "too_many_facts"


def test_long_paths_are_no_lens(spark):
    hops = spark.createDataFrame(
        [("q", 0, i, f"n{i}", f"n{i + 1}", f"e{i}") for i in range(1, 27)] + [("q", 1, 1, "a", "b", "e")],
        "question_id string, group_rank int, hop int, source_node string, target_node string, edge_id string")
    assert [(r.group_rank, r.hop) for r in paths.lens_selection(hops).collect()] == [(1, 1)]
    assert paths.lens_selection(hops.where("group_rank = 0")).count() == 0


def test_sessions_whose_files_come_in_any_order(spark, tmp_path):
    at = lambda minute: datetime.datetime(2024, 1, 1, 10, minute)
    rows = [(f"s{s}", kind, "r1", at(minute), minute) for s in range(10) for kind, minute in
            (("session_completed", 20), ("query_started", 30), ("session_started", 1), ("query_started", 15), ("session_completed", 10))]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "session_id string, type string, revision_id string, timestamp timestamp, seq long").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / f"in/part={(i * 7) % 5}"))
    schema = spark.read.parquet(str(tmp_path / "in")).drop("part").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 9).parquet(str(tmp_path / "in")).withWatermark("timestamp", "1 day")
    found = streaming.drain(streaming.session_state(stream), "update")
    last = found.groupBy("session_id").agg(F.max_by(F.struct("state", "late_events", "revision_id"), "batch").alias("r")).select("r.*")
    assert {tuple(r) for r in last.collect()} == {("completed", 3, "r1")} and last.count() == 10


def test_hubs_keep_all_relations_on_several_cards(spark, monkeypatch):
    from repograph import constants, schemas
    from repograph.operators import cards

    monkeypatch.setattr(constants, "MAX_DEGREE", 20)
    nodes = spark.createDataFrame(
        [{"repository_id": "r", "revision_id": "v", "id": f"n{i}", "logical_id": f"n{i}", "kind": "FUNCTION", "qualified_name": f"m.f{i}",
          "display_name": f"f{i}", "path": "m.py"} for i in range(101)], schemas.NODES)
    edges = spark.createDataFrame(
        [{"repository_id": "r", "revision_id": "v", "id": f"e{i}", "source_id": "n0", "target_id": f"n{i}", "predicate": "CALLS",
          "quality": "exact", "owner_source_id": "n0", "extractor": "x", "extractor_version": "1",
          "evidence": [{"path": "m.py", "start_line": i, "end_line": i}]} for i in range(1, 101)], schemas.EDGES)
    made = cards.build_cards(nodes, edges)
    hub = made.where("node_id = 'n0'").collect()
    assert len(hub) == 8 and len({r.source_id for r in hub}) == 8
    assert sorted(x.target for r in hub for x in r.relations) == sorted(f"n{i}" for i in range(1, 101))
    assert sum(r.content.count("- outgoing") for r in hub) == 100
    assert made.where("node_id <> 'n0'").count() == 100
    assert cards.unfit_relations(nodes, edges).count() == 0
    long = made.withColumn("qualified_name", F.repeat(F.lit("x"), 2000))
    assert cards.card_records(long).count() == 0 and cards.unfit_cards(long).count() == 108


class HeldState:
    """A state key between triggers."""

    def __init__(self):
        self.value, self.watermark, self.hasTimedOut, self.timeout = None, 0, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def getCurrentWatermarkMs(self):
        return self.watermark

    def setTimeoutTimestamp(self, at):
        assert at > self.watermark
        self.timeout = at


def test_a_bucket_of_sessions_is_one_state_key_and_forgets_each_by_itself():
    import pandas as pd

    follow, state = streaming._session(60_000), HeldState()

    def trigger(*rows):
        frame = pd.DataFrame([(s, k, "r1", pd.Timestamp(at, unit="s"), n) for n, (s, k, at) in enumerate(rows)],
                             columns=["session_id", "type", "revision_id", "timestamp", "seq"])
        return {tuple(r) for out in follow((7,), iter([frame] if rows else []), state) for r in out.to_numpy().tolist()}

    assert trigger(("a", "session_started", 10), ("b", "session_completed", 20), ("b", "query_started", 25)) == {
        ("a", "r1", "active", 0), ("b", None, "unknown", 1)}
    assert trigger(("b", "session_started", 5), ("c", "session_started", 90)) == {
        ("b", "r1", "completed", 1), ("c", "r1", "active", 0)}
    state.watermark = 71_000
    assert trigger(("b", "query_started", 80)) == {("b", "r1", "completed", 2)}
    assert {row[0] for row in state.value[0]} == {"b", "c"} and state.timeout == 140_000
    state.watermark, state.hasTimedOut = 140_500, True
    assert trigger() == set() and {row[0] for row in state.value[0]} == {"c"} and state.timeout == 150_000
    state.watermark = 150_500
    assert trigger() == set() and not state.exists
