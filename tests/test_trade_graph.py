"""The trade graph's stored tables and what a comparison moves."""

import os

import duckdb
from pyspark.sql import functions as F

from repograph.operators import cards, diff, evolution, projection
from repograph.plans import catalog, catalog_evolution, catalog_graph, fixtures
from repograph.session import run_folder


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(folder) for name in names)


def test_store_of_edges_is_no_larger_than_its_input(spark):
    source = "/root/testdata/sf0.01"
    held = _bytes(run_folder(spark))
    fixtures.build_edges(spark, source, "before").select("id").collect()
    for name in [key for key in fixtures._READ if source in key and key[-1] in ("before", "after")]:
        del fixtures._READ[name]
    fixtures.trade_edges(spark, source, "after").select("id").collect()
    taken = sum(os.path.getsize(f"{source}/{name}.parquet") for name in ("lineitem", "orders"))
    assert 0 < _bytes(run_folder(spark)) - held < 2 * taken


def test_lines_without_a_status_join_the_inferred_ones(spark, tmp_path):
    source, folder = "/root/testdata/sf0.001", str(tmp_path)
    for name in ("region", "nation", "customer", "supplier", "orders"):
        os.symlink(f"{source}/{name}.parquet", f"{folder}/{name}.parquet")
    line = spark.read.parquet(f"{source}/lineitem.parquet").where("l_orderkey % 11 = 0 AND l_orderkey % 10 > 1").limit(1)
    twice = [line.withColumns({"l_linenumber": F.lit(n), "l_linestatus": F.lit(status)})
             for n, status in ((1, None), (2, "O"), (3, "F"))]
    rows = twice[0].unionByName(twice[1]).unionByName(twice[2])
    rows.withColumn("l_linestatus", F.col("l_linestatus").cast("string")).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    sizes = lambda revision: {
        r["quality"]: r["n"] for r in fixtures.build_edges(spark, folder, revision)
        .select("quality", F.size("evidence").alias("n")).collect()}
    assert sizes("before") == {"inferred": 2, "exact": 1}
    assert sizes("after") == {"inferred": 2, "exact": 1}


def test_changes_without_records_move_no_record(spark):
    node = {name: "x" for name in ("body_fingerprint", "docstring", "attributes_json", "content_hash", "parser",
                                   "parser_version", "path", "signature", "display_name")}
    schema = "repository_id string, id string, is_test boolean, is_entry_point boolean, entry_reasons array<string>, " \
             "span struct<start_line: int>, " + ", ".join(f"{name} string" for name in node)
    row = lambda key, **other: {"repository_id": "r", "id": key, "is_test": False, "is_entry_point": False,
                                "entry_reasons": None, "span": (1,), **node, **other}
    before = spark.createDataFrame([row("a"), row("b"), row("c"), row("d", signature=None)], schema)
    after = spark.createDataFrame([row("a"), row("b", signature="y", docstring=None), row("d", signature=""), row("e")], schema)
    found = diff.node_changes(before, after).select("id", "change", "changed_fields")
    assert "display_name" not in found._jdf.queryExecution().optimizedPlan().toString().replace(
        "LogicalRDD", "").split("Project", 2)[1]
    assert {(r["id"], r["change"], tuple(r["changed_fields"])) for r in found.collect()} == {
        ("b", "modified", ("attributes", "signature")), ("c", "removed", ()), ("d", "modified", ("signature",)),
        ("e", "added", ())}


def test_keys_of_facts_are_those_of_whole_facts_and_hold_no_record(spark):
    source = "/root/testdata/sf0.001"
    nodes = [fixtures.trade_nodes(spark, source, r) for r in ("before", "after")]
    edges = [fixtures.trade_edges(spark, source, r) for r in ("before", "after")]
    delta = diff.compare(nodes[0], edges[0], nodes[1], edges[1], with_cycles=False, with_proofs=True)
    keys, whole = evolution.fact_keys(delta, "before", "after"), evolution.change_facts(delta, *nodes, "before", "after")
    rows = lambda table, *columns: sorted(table.select(*columns).collect(), key=repr)
    same = ("fact_id", "kind", "quality", "confidence", "explanation")
    assert rows(keys, *same) == rows(whole, *same) != []
    graph = ("fact_id", "source", "target", "predicate", "context")
    assert rows(evolution.fact_relations(keys), *graph) == rows(evolution.fact_relations(whole), *graph)
    first = F.coalesce(F.get("before_nodes", F.lit(0)), F.get("after_nodes", F.lit(0)))["path"].alias("path")
    assert rows(evolution.with_paths(keys, *nodes), "fact_id", "path") == rows(whole, "fact_id", first)
    plain = diff.compare(nodes[0], edges[0], nodes[1], edges[1], with_cycles=False)
    assert plain["edge_marks"].schema["before"].dataType.names == ["source_id", "predicate", "target_id", "quality"]
    assert "content_hash" not in plain["node_marks"].schema["before"].dataType.names


def test_cards_are_read_for_their_text_and_size_without_gathered_relations(spark):
    source = "/root/testdata/sf0.001"
    built = cards.build_cards(fixtures.trade_nodes(spark, source), fixtures.trade_edges(spark, source))
    assert built.where(F.size("relations") != F.col("relation_count")).isEmpty()
    plan = built.select("source_id", "content", "relation_count")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and plan.count("collect_list") == 1


def test_change_cards_are_made_once_for_the_queries_that_read_them(spark, monkeypatch):
    source, calls = "/root/testdata/sf0.001/", []
    for module, name in ((evolution, "change_cards"), (diff, "compare")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, _real=real, _name=name, **k: (calls.append(_name), _real(*a, **k))[1])
    found = catalog_evolution.change_round_trip(spark, source)
    checks = catalog_evolution.stored_event_checks(spark, source)
    assert sorted(calls) == ["change_cards", "compare"]
    assert found.select("repository_id").distinct().count() == checks.count() > 0


def test_a_file_without_a_current_path_is_unresolved_in_query_and_sql(spark, tmp_path):
    source, folder = "/root/testdata/sf0.001", str(tmp_path)
    for name in ("region", "nation", "customer", "supplier", "part"):
        os.symlink(f"{source}/{name}.parquet", f"{folder}/{name}.parquet")
    # Orders that end in 1 are missing in the second revision, so their customers have no path there.
    keys = spark.read.parquet(f"{source}/orders.parquet").where("o_orderkey % 10 = 1 OR o_custkey % 3 = 0")
    keys.coalesce(1).write.parquet(f"{folder}/orders.parquet")
    lines = spark.read.parquet(f"{source}/lineitem.parquet").where("l_linestatus = 'F'")
    lines.coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    got = {tuple(r) for r in catalog_evolution.lens_drift(spark, folder).collect()}
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}/{name}.parquet'")
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    assert got == set(con.execute(catalog.SQL["lens_drift"]).fetchall())
    assert "unresolved" in {row[3] for row in got}


def test_relations_carry_the_ends_that_their_nodes_have_and_contexts_join_no_nodes(spark):
    source = "/root/testdata/sf0.001"
    nodes, edges = fixtures.trade_nodes(spark, source, "after"), fixtures.trade_edges(spark, source, "after")
    relations = fixtures.trade_relations(spark, source, "after")
    rows = lambda table: sorted(table.select("id", "source_end", "target_end").collect(), key=repr)
    assert rows(projection.with_ends(nodes, edges)) == rows(relations) != []
    joined, read = cards.relation_contexts(nodes, edges), cards.relation_contexts(None, relations)
    assert joined.columns == read.columns and sorted(joined.collect(), key=repr) == sorted(read.collect(), key=repr)
    plan = catalog_evolution.relation_contexts(spark, source)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def odd_graph(spark):
    """Ends that are groups themselves, lie in no group, or share a path; evidence of several edges."""

    named = [("root", "REPOSITORY", "."), ("A", "PACKAGE", "a"), ("B", "PACKAGE", "a/b"), ("X", "FILE", "a/x.py"),
             ("Y", "FILE", "a/b/y.py"), ("Y2", "FILE", "a/b/y.py"), ("T", "FILE", "top.py"), ("x1", "FUNCTION", "a/x.py"),
             ("x2", "FUNCTION", "a/x.py"), ("y1", "FUNCTION", "a/b/y.py"), ("z1", "FUNCTION", "a/c/z.py"),
             ("t1", "FUNCTION", "top.py")]
    keys = "repository_id string, revision_id string"
    nodes = spark.createDataFrame(
        [("r", v, i, k, p, i, f"l:{i}", None) for v in "12" for i, k, p in named],
        f"{keys}, id string, kind string, path string, qualified_name string, logical_id string, span struct<start_line: int>")
    pairs = [(a, b) for a in "A B X Y x1 x2 y1 z1 t1 root".split() for b in "A B X Y2 x2 y1 z1 T t1".split()]
    rows = [("r", v, f"e{n}", a, "CALLS" if n % 3 else "IMPORTS", b, "exact" if n % 7 else "inferred",
             [(f"p{n % 5}",), (f"p{n}",)][:n % 4] if n % 9 else None) for v in "12" for n, (a, b) in enumerate(pairs)]
    rows.append(("r", "1", "gone", "x1", "CALLS", "nobody", "exact", []))
    edges = spark.createDataFrame(
        rows, f"{keys}, id string, source_id string, predicate string, target_id string, quality string, "
        "evidence array<struct<id: string>>")
    return nodes, edges


def test_rollups_by_path_are_those_by_id(spark):
    nodes, edges = odd_graph(spark)
    placed = projection.with_ends(nodes, edges)
    rows = lambda table: sorted(table.collect(), key=repr)
    for depth in ("packages", "files"):
        seen = projection.visible_nodes(nodes, depth, 2)
        for visible in (None, seen):
            by_id = projection.rollup_edges(nodes, edges, depth, visible)
            by_path = projection.rollup_edges(nodes, placed, depth, visible)
            assert rows(by_id) == rows(by_path) != []
        assert rows(projection.rollup_members(nodes, edges, depth)) == rows(projection.rollup_members(nodes, placed, depth))
    query = catalog_graph.rollup_files(spark, "/root/testdata/sf0.001")
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4 and "sha2(concat_ws(:, evidence" not in plan


def test_evidence_of_several_relations_counts_once_and_members_are_read_once(spark):
    nodes, edges = odd_graph(spark)
    placed = projection.with_ends(nodes, edges)
    for depth in ("packages", "files"):
        members, want = {}, {}
        for r in projection.rollup_members(nodes, edges, depth).collect():
            found = members.setdefault((r.revision_id, r.id), (set(), set()))
            found[0].add(r.edge_id)
            found[1].update([r.evidence_id] if r.evidence_id else [])
        want = {key: (len(e), len(p)) for key, (e, p) in members.items()}
        for table in (edges, placed):
            got = projection.rollup_evidence_counts(nodes, table, depth)
            assert {(r.revision_id, r.id): (r.relation_count, r.evidence_count) for r in got.collect()} == want
        assert any(p < e for e, p in want.values())
    counts = catalog_graph.rollup_evidence_counts(spark, "/root/testdata/sf0.001")
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.count("numbers#") and plan.count("Relation [o_orderkey") == 1
