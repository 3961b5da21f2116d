"""Comparisons move changed rows only, and find what a join of all rows would find."""

from pyspark.sql import functions as F

from repograph.functions import ids, text
from repograph.operators import diff, evolution, sieve
from repograph.session import cut

NODE = ("repository_id string, id string, body_fingerprint string, docstring string, is_test boolean, is_entry_point boolean, "
        "entry_reasons array<string>, attributes_json string, content_hash string, parser string, parser_version string, "
        "path string, signature string, span struct<start_line: int>")


def _node(key, said="s", repository="r"):
    return (repository, key, "f", None, False, False, None, None, "h", "p", "1", "a.py", said, (1,))


def _all_pairs(before, after):
    """The changes of nodes by a plain join of all rows."""

    key = ["repository_id", "id"]
    side = lambda rows, name: rows.select(*key, F.col("signature").alias(name), F.lit(1).alias(f"in_{name}"))
    met = side(before, "b").join(side(after, "a"), key, "full_outer")
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(
        ~F.col("b").eqNullSafe(F.col("a")), "modified")
    return sorted((tuple(r) for r in met.select("id", change.alias("c")).where("c is not null").collect()), key=repr)


def test_sieve_lets_its_keys_pass_and_holds_most_others(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("name"))
    hashes = lambda some: cut(some.select(sieve.key_hash("name").alias("h")))
    wanted = rows.where("name % 100 = 7")
    passed = sieve.Sieve(hashes(wanted)).passed(rows, "name")
    assert passed.join(wanted, "name", "left_semi").count() == 200
    assert passed.count() < 3_000
    # At its bound it lets more pass, and still all of its keys.
    small = sieve.Sieve(hashes(wanted), most_words=3).passed(rows, "name")
    assert small.join(wanted, "name", "left_semi").count() == 200
    assert sieve.Sieve(hashes(rows.limit(0))).passed(rows, "name").count() == 0


def test_only_rows_of_changed_nodes_are_moved(spark):
    before = spark.createDataFrame([_node(f"n{i}") for i in range(3_000)], NODE)
    after = spark.createDataFrame([_node(f"n{i}", "t" if i % 300 == 5 else "s") for i in range(10, 3_010)], NODE)
    keys = diff._changed_nodes(before, after)
    assert keys.passed(before, "repository_id", "id").count() < 600
    found = diff.node_changes(before, after, keys=keys).select("id", "change")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == _all_pairs(before, after)


def test_repeated_and_missing_ids_change_as_in_a_join_of_all_rows(spark):
    odd = "node_" + "0" * 24
    before = spark.createDataFrame(
        [_node("twice"), _node("twice", "t"), _node("same"), _node("same"), _node(None), _node("gone"), _node("gone"),
         _node("null", None), _node(odd), _node("x", repository=None)], NODE)
    after = spark.createDataFrame(
        [_node("twice"), _node("same"), _node("same"), _node("same"), _node(None), _node(None), _node("null", ""),
         _node(odd.upper()), _node(odd + "\n"), _node("x", repository=None)], NODE)
    found = diff.node_changes(before, after).select("id", "change").collect()
    assert sorted((tuple(r) for r in found), key=repr) == _all_pairs(before, after)


def test_packed_ids_and_hashes_are_read_back(spark):
    told = ["node_" + "0a" * 12, "node_" + "0A" * 12, "node_" + "0a" * 12 + "\n", "edge_" + "0a" * 12, "", "a", None, "é", "\x00" * 13]
    rows = spark.createDataFrame([(v,) for v in told], "v string")
    shown = rows.select("v", ids.unpacked(ids.packed(F.col("v"), "node"), "node"),
                        F.octet_length(ids.packed(F.col("v"), "node"))).collect()
    assert all(r[0] == r[1] for r in shown) and [v for v, _, size in shown if size == 12] == told[:1]
    hashes = spark.createDataFrame([("ab" * 32,), ("AB" * 32,), ("h",), (None,)], "v string")
    assert all(r[0] == r[1] for r in hashes.select("v", text.unpacked_hash(text.packed_hash(F.col("v")))).collect())


def test_first_files_are_found_for_some_of_many_nodes(spark):
    nodes = spark.createDataFrame([("r", f"n{i}", f"p{i % 7}") for i in range(2_000)], "repository_id string, id string, path string")
    keys = spark.createDataFrame(
        [("r", ["n3"], [], None), ("r", [], ["n4"], None), ("r", ["lost"], [], None), ("r", ["n5"], [], "own")],
        "repository_id string, before_nodes array<string>, after_nodes array<string>, path string")
    found = evolution.with_paths(keys, nodes, nodes).select("path").collect()
    assert sorted(r.path for r in found) == ["own", "p3", "p4"]


def test_pages_are_numbered_where_they_met_their_event(spark):
    none = "CAST(array() AS array<string>)"
    lists = ", ".join(f"{none} AS {name}" for name in (
        "before_nodes", "after_nodes", "before_relations", "after_relations", "changed_fields", "matched_signals"))
    facts = spark.createDataFrame([("r", "f2"), ("r", "f1"), ("q", "f3")], "repository_id string, fact_id string").selectExpr(
        "*", "'b' AS before_revision_id", "'a' AS after_revision_id", "'node_added' AS kind", "'exact' AS quality",
        "'x' AS explanation", "CAST(NULL AS double) AS confidence", *lists.split(", CAST")[:1],
        *[f"CAST{part}" for part in lists.split(", CAST")[1:]])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cards = evolution.change_cards(evolution.change_events(facts), facts).select("node_id", "page_index", "page_count")
        plan = cards._jdf.queryExecution().executedPlan().toString()
        found = {tuple(r) for r in cards.where("page_index > 0").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(event_id" not in plan
    assert found == {("f1", 1, 2), ("f2", 2, 2), ("f3", 1, 1)}
