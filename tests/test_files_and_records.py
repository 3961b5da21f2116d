import json
import os

import pytest
from pyspark.sql import functions as F

from repograph.operators import cards, contrast, evaluation, lens, observe, publish, validate
from repograph.plans import index
from repograph.sources import files as sources
from repograph.sources import graph as graphs
from repograph.sources import records
from repograph.streaming import events as streaming
from tests.test_extract import EVAL, table


def test_ignore_rules(spark, tmp_path):
    tree = {
        ".gitignore": "*.log\n!keep.log\n/out/\nbuild/\n# c\ndocs/**/x.md\n", "a.log": "1", "keep.log": "1", "out/a.py": "1",
        "src/out/a.py": "1", "src/build/b.py": "1", "docs/a/b/x.md": "1", "docs/x.md": "1", "node_modules/m/i.js": "1",
        "pkg/__init__.py": "",
        ".env.local": "1", "key.PEM": "1", "bin.dat": "a\x00b", "big.txt": "x" * 200, "ok/tests/a.ts": "1",
        "leak.txt": "AKIA" + "A" * 16, "dist/g.generated.py": "x = 1"}
    for path, body in tree.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    os.symlink(tmp_path / "ok", tmp_path / "link")
    os.symlink(tmp_path / "keep.log", tmp_path / "soft.txt")
    found = sources.scan_files(spark, str(tmp_path), "r", "v")
    rules = sources.ignore_rules(found, deny_globs=["secret*/"])
    judged = sources.classify_files(found, rules, max_bytes=100)
    got = {r.path: (r.ignore_reason, r.ignored_path) for r in judged.collect()}
    assert got["a.log"] == ("ignore-rule", "a.log") and got["keep.log"][0] is None
    assert got["out/a.py"] == ("ignore-rule", "out") and got["src/out/a.py"][0] is None
    assert got["src/build/b.py"] == ("ignore-rule", "src/build")
    assert got["docs/a/b/x.md"][0] == got["docs/x.md"][0] == "ignore-rule"
    assert got["node_modules"] == ("default-ignore", "node_modules")
    reasons = {p: r for p, (r, _) in got.items()}
    assert [reasons[p] for p in (".gitignore", ".env.local", "key.PEM", "bin.dat", "big.txt", "leak.txt")] == [
        "control-file", "secret-name", "secret-name", "binary", "oversized", "secret-content"]
    assert reasons["soft.txt"] == reasons["link"] == "symlink" and "link/tests/a.ts" not in reasons
    assert reasons["pkg/__init__.py"] is None
    kept = {r.path: r for r in sources.tag_files(sources.kept_files(judged)).collect()}
    assert kept["ok/tests/a.ts"].language == "typescript" and kept["ok/tests/a.ts"].is_test
    assert kept["dist/g.generated.py"].is_generated and not kept["keep.log"].is_generated


@pytest.fixture(scope="module")
def graph(spark):
    return index.index_files(table(spark, {"evaluation-fixture": EVAL}))


def test_graph_store(spark, graph, tmp_path):
    root = str(tmp_path / "store")
    graphs.write_graph(graph["nodes"], graph["edges"], root)
    nodes, edges = graphs.read_graph(spark, root, "evaluation-fixture", "r1")
    assert nodes.count() == graph["nodes"].count() and edges.count() == graph["edges"].count()
    assert graphs.damaged_revisions(spark, root).collect() == []
    assert graphs.graph_size(nodes, edges).first().bytes > 1000
    graph["nodes"].limit(1).write.mode("append").partitionBy("repository_id", "revision_id").parquet(f"{root}/nodes")
    assert [r.revision_id for r in graphs.damaged_revisions(spark, root).collect()] == ["r1"]


def test_gold_and_corpus(spark, graph, tmp_path):
    nodes, edges = graph["nodes"], graph["edges"].where("predicate in ('CALLS', 'TESTS')")
    edge = edges.where("id = 'edge_52414a8d414e6fbee4c6da78'").first()
    ends = {r.id: r.logical_id for r in nodes.collect()}
    proof = {("evidence_id" if k == "id" else k): v for k, v in edge.evidence[0].asDict().items() if k != "explanation"}
    gold = {"repository_id": "evaluation-fixture", "revision_id": "r1", "questions": [{
        "id": "q1", "prompt": "who loads?", "required_node_logical_ids": [ends[edge.source_id]],
        "required_relations": [{"edge_id": edge.id, "source_logical_id": ends[edge.source_id], "predicate": "CALLS",
                                "target_logical_id": ends[edge.target_id], "quality": "exact", "evidence": [proof]}]}]}
    (tmp_path / "gold.json").write_text(json.dumps(gold))
    read = records.read_gold(spark, str(tmp_path / "gold.json"))
    assert evaluation.gold_problems(read, nodes, edges).collect() == []
    wrong = {**read, "evidence": read["evidence"].withColumn("start_line", F.lit(99))}
    assert [r.record for r in evaluation.gold_problems(wrong, nodes, edges).collect()] == ["evidence"]
    files = spark.createDataFrame(list(EVAL.items()), "path string, text string")
    functions = nodes.where("span is not null")
    excerpt = {r.id: r.excerpt for r in index.resolve.excerpts(graph["facts"]).collect()}
    out = {}
    for e in edges.collect():
        for item in e.evidence:
            out.setdefault(e.source_id, {})[item.id] = {("evidence_id" if k == "id" else k): v for k, v in item.asDict().items() if k != "explanation"}
    docs = [{"document_id": n.id, "node_id": n.id, "content": excerpt[n.id], "evidence": list(out.get(n.id, {}).values())} for n in functions.collect()]
    (tmp_path / "corpus.json").write_text(json.dumps(docs))
    corpus = records.read_corpus(spark, str(tmp_path / "corpus.json"))
    assert evaluation.corpus_problems(corpus, functions, edges, files).collect() == []
    bad = corpus.withColumn("content", F.concat("content", F.lit(" ")))
    assert {r.problem for r in evaluation.corpus_problems(bad, functions, edges, files).collect()} == {"not source-derived"}


def test_responses(spark, tmp_path):
    ent = lambda n: {"identifier": f"repo:{n}", "entity_id": None, "name": n, "type": "FUNCTION", "namespace": "r"}
    body = {"data": {
        "chunks": [{"chunk_uuid": "c1", "id": "s1", "chunk_content": "text", "relevancy_score": 0.5,
                    "metadata": {"revision_id": "r1", "repository_id": "r", "entity_kind": "FUNCTION", "is_test": False},
                    "additional_metadata": {"node_id": "n1", "start_line": 1, "start_column": 0, "end_line": 2, "end_column": 3}}],
        "sources": [{"id": "s1", "title": "t", "type": "code", "metadata": {"revision_id": "r1"}, "additional_metadata": {}}],
        "graph_context": {"query_paths": [{"group_id": "g", "source_chunk_ids": ["c1"], "triplets": [
            {"source": ent("a"), "target": ent("b"), "relation": {"relationship_id": "x", "canonical_predicate": "CALLS", "chunk_id": "c1"}}]}],
            "chunk_relations": []}}}
    (tmp_path / "q1.json").write_text(json.dumps(body))
    read = records.read_responses(spark, str(tmp_path))
    row = read["chunks"].first()
    assert (row.question_id, row["rank"], row.node_id, row.span.end_line, row.is_test) == ("q1.json", 1, "n1", 2, "false")
    hop = read["triplets"].first()
    assert (hop.list, hop.group_rank, hop.hop, hop.relation.id, hop.source.name) == ("path", 1, 1, "x", "a")
    assert read["groups"].first().source_chunk_ids == ["c1"] and read["sources"].first().position == 1


def test_runs(spark, tmp_path):
    base = ['{"type":"system","subtype":"init","model":"m","tools":["Read"],"mcp_servers":[{"name":"s"},{}]}', "noise",
            '{"type":"assistant","message":{"content":[{"type":"tool_use","name":"Read","input":{"file_path":" a\\n b "}},{"type":"tool_use","name":"Read","input":{"file_path":"a b"}}]}}',
            '{"type":"result","num_turns":4,"usage":{"input_tokens":5,"output_tokens":7,"cache_read_input_tokens":1},"total_cost_usd":0.5,"duration_ms":900,"result":"done"}']
    other = [base[0], '{"type":"result","is_error":true,"subtype":"limit","num_turns":1}']
    (tmp_path / "r1.base.jsonl").write_text("\n".join(base))
    (tmp_path / "r1.other.jsonl").write_text("\n".join(other))
    traces = contrast.run_traces(contrast.read_lines(records.read_transcripts(spark, str(tmp_path))))
    got = {r.side: r for r in traces.collect()}
    assert (got["base"].status, got["base"].tool_calls, got["base"].files_read, got["base"].turns) == ("completed", 2, 1, 4)
    assert got["base"].tools == ["Read"] and got["base"].servers == ["s"] and got["base"].answer == "done"
    assert (got["other"].status, got["other"].error, got["other"].input_tokens) == ("failed", "limit", None)
    rows = {r.label: r for r in contrast.contrast(traces, ["run_id"]).collect()}
    assert len(rows) == 8 and rows["Total tokens"].difference == -13.0 and rows["Total tokens"].other_lower
    assert rows["Cost"].difference is None and not rows["Cost"].comparable
    lines = spark.createDataFrame([("r", "base", i, v) for i, v in enumerate([base[0], base[2], "x" * 50, base[3]])], "run_id string, side string, line_no int, line string")
    assert contrast.run_traces(contrast.read_lines(lines, max_line=400)).first().status == "completed"
    assert contrast.run_traces(contrast.read_lines(lines, max_events=2)).first().status == "running"


def test_lens(spark, graph):
    calls = graph["edges"].where("predicate = 'CALLS'")
    view_edges = calls.withColumn("origin", F.lit("byog"))
    one = spark.createDataFrame([("evaluation-fixture", "r1", "Login", "How login works", "v", None)],
                                "repository_id string, revision_id string, name string, purpose string, view_id string, notes string")
    one = one.withColumn("lens_id", lens.lens_id(F.col("repository_id")))
    chain = calls.where("id in ('edge_09854ee9a3f80c9d805c034d', 'edge_52414a8d414e6fbee4c6da78')")
    at = lambda df, c, n: df.select(c).crossJoin(one.select("lens_id")).withColumnRenamed(c, n)
    anchors = at(chain.where("id = 'edge_09854ee9a3f80c9d805c034d'"), "source_id", "node_id")
    saved = lens.build_lens(one, anchors, at(chain, "id", "edge_id"), graph["nodes"], view_edges)
    assert saved["problems"].collect() == [] and saved["entities"].count() == 3
    card = lens.lens_cards(saved).first()
    assert card.fits and "Anchors: " in card.content and json.loads(card.record_json)["baseline_hops"]
    longer = lens.build_lens(one, anchors, at(calls, "id", "edge_id"), graph["nodes"], view_edges)
    drift = lambda a, b: lens.lens_drift(a, b).first().classification
    assert drift(saved, saved) == "unchanged" and drift(saved, longer) == "path_extended" and drift(longer, saved) == "path_shortened"
    assert drift(saved, {**saved, "lenses": one.limit(0)}) == "unresolved"
    assert drift(saved, {**saved, "entities": saved["entities"].where("not is_anchor")}) == "anchor_removed"
    split = lens.build_lens(one, at(graph["nodes"].where("kind = 'REPOSITORY'"), "id", "node_id"), at(chain, "id", "edge_id"),
                            graph["nodes"], view_edges.withColumn("origin", F.lit("auto")))
    assert {r.problem for r in split["problems"].collect()} == {"not_owned", "not_connected"}
    looked = spark.createDataFrame([("evaluation-fixture", "LOGIN"), ("evaluation-fixture", "nope")], "repository_id string, lookup string")
    assert {r.lookup: r.matches for r in lens.open_lens(one, looked).collect()} == {"LOGIN": 1, "nope": 0}
    kept = lens.accept_lens(saved, longer)
    assert kept["hops"].count() == 3 and kept["lenses"].count() == 1


def test_publish_round(spark, graph, tmp_path):
    made = index.index_cards(graph)
    hashes = cards.card_hash(made)
    empty = hashes.limit(0)
    plan = publish.publish_plan(empty, hashes)
    snapshot, manifest = publish.apply_plan(made.limit(0), made, plan)
    publish.write_snapshot(snapshot, manifest, str(tmp_path / "out"), "s1")
    stored = spark.read.parquet(str(tmp_path / "out/manifest/s1"))
    assert publish.snapshot_mismatches(stored, hashes).collect() == []
    ready = spark.createDataFrame([("evaluation-fixture", "r1", "r1")], "repository_id string, ready_revision string, revision_id string")
    assert publish.verifies_snapshot(stored, hashes, ready).first().verified
    assert {r.action for r in publish.publish_plan(stored, hashes).collect()} == {"unchanged"}
    assert cards.card_metadata(made).where("not fits").count() == 0
    long = made.withColumn("signature", F.lit("é" * 300))
    assert "signature" not in cards.card_metadata(long).first().metadata_json
    records.write_cards(cards.card_records(made), cards.graph_payload(made), str(tmp_path / "cards"))
    assert spark.read.json(str(tmp_path / "cards/graphs")).count() < made.count() == cards.preview(made).count()
    assert validate.card_violations(made).count() == 0


def test_streamed_sessions(spark, tmp_path):
    rows = [("e1", "s1", 1, "session_started"), ("e2", "s1", 2, "session_completed"), ("e3", "s1", 3, "query_started"),
            ("e4", "s2", 4, "query_started"), ("e5", "s3", 5, "session_started")]
    with open(tmp_path / "a.json", "w") as out:
        for event, session, seq, kind in rows:
            out.write(json.dumps({"event_id": event, "session_id": session, "timestamp": f"2024-01-01T00:00:0{seq}Z", "type": kind,
                                  "revision_id": "r1", "entity_ids": [], "relationship_ids": [], "seq": seq}) + "\n")
        out.write(json.dumps({"event_id": "bad", "session_id": "s1", "timestamp": "soon", "type": "query_started", "revision_id": "r1",
                              "entity_ids": [], "relationship_ids": []}) + "\n")
    stream = streaming.first_arrivals(streaming.stream_events(spark, str(tmp_path)))
    found = streaming.drain(streaming.session_state(stream), "update").collect()
    assert {(r.session_id, r.state) for r in found} == {("s1", "completed"), ("s2", "unknown"), ("s3", "active")}
    batch = observe.valid_events(streaming.read_events(spark, str(tmp_path)))
    got = {r.session_id: (r.state, r.late_events) for r in observe.sessions(batch).collect()}
    assert got == {"s1": ("completed", 1), "s2": ("unknown", 0), "s3": ("active", 0)}
    assert observe.sole_active_session(observe.sessions(batch)).first().session_id == "s3"
    conflict = observe.revision_conflicts(batch.withColumn("revision_id", F.lit("r2")), observe.sessions(batch))
    assert conflict.count() == 4


def test_selection(spark):
    span = "struct<start_line:int,start_column:int,end_line:int,end_column:int>"
    nodes = spark.createDataFrame([("v", "n1", "a.py", (1, 0, 2, 0)), ("v", "n2", ".", None)], f"view_id string, id string, path string, span {span}")
    edges = spark.createDataFrame([("v", "e1", [("a.py", 1, 2)]), ("v", "e2", [])],
                                  "view_id string, id string, evidence array<struct<path:string,start_line:int,end_line:int>>")
    picks = spark.createDataFrame([("v", "node", "n1", "open"), ("v", "node", "n2", "open"), ("v", "node", "n2", "pin"), ("v", "node", "zz", "pin"),
                                   ("v", "edge", "e1", "open"), ("v", "edge", "e2", "open")], "view_id string, item_kind string, item_id string, action string")
    got = {(r.item_id, r.action, r.problem) for r in observe.check_selection(nodes, edges, picks).collect()}
    assert got == {("n2", "open", "no_evidence"), ("zz", "pin", "unknown"), ("e2", "open", "no_evidence")}
