"""Queries on the trade graph: identity, rollups, comparison, cycles, digests, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from repograph.operators import diff, digest, projection, scc, validate
from repograph.plans import fixtures, oracle
from repograph.plans.catalog import register
from repograph.session import KEYS, cut

BEFORE = oracle.graph("before")
BOTH = oracle.graph("before", "after")


def _graph(spark, sf_dir, revision="before"):
    return (
        fixtures.trade_nodes(spark, sf_dir, revision),
        fixtures.trade_edges(spark, sf_dir, revision),
    )


def _placed_graph(spark, sf_dir, revision="before"):
    """Files and packages, and edges with their ends: all that a rollup reads."""

    return (
        fixtures.trade_containers(spark, sf_dir, revision),
        fixtures.trade_relations(spark, sf_dir, revision),
    )


def flagship(spark, sf_dir):
    """Package rollup of the trade graph: the 20 strongest links between packages."""

    rolled = projection.rollup_edges(*_placed_graph(spark, sf_dir), "packages")
    return projection.top_aggregates(rolled, 20).drop("position").orderBy(
        F.desc("exact_relation_count"), "predicate", "id"
    )


@register("node_ids", f"{BEFORE} SELECT id, logical_id, kind, path, content_hash FROM nodes_before")
def node_ids(spark, sf_dir):
    nodes = fixtures.trade_nodes(spark, sf_dir)
    return nodes.select("id", "logical_id", "kind", "path", "content_hash")


@register(
    "edge_ids",
    f"{BEFORE} SELECT id, logical_id, quality, confidence, evidence_count FROM edges_before",
)
def edge_ids(spark, sf_dir):
    edges = fixtures.trade_edges(spark, sf_dir)
    return edges.select(
        "id", "logical_id", "quality", "confidence",
        F.size("evidence").cast("bigint").alias("evidence_count"),
    )


@register(
    "evidence_ids",
    f"{BEFORE} SELECT id AS edge_id, unnest(string_split(evidence_ids, ',')) AS evidence_id "
    "FROM edges_before",
)
def evidence_ids(spark, sf_dir):
    edges = fixtures.trade_edges(spark, sf_dir)
    return edges.select(F.col("id").alias("edge_id"), F.explode("evidence.id").alias("evidence_id"))


ROLLUP = "id, source_group_id, predicate, target_group_id, exact_relation_count"
RANKED = (
    "row_number() OVER (ORDER BY exact_relation_count DESC, predicate, id) AS position"
)


@register(
    "rollup_packages",
    f"{BEFORE}, {oracle.rollup_cte('packages')} SELECT {ROLLUP} FROM rolled",
)
def rollup_packages(spark, sf_dir):
    return projection.rollup_edges(*_placed_graph(spark, sf_dir), "packages").drop(*KEYS)


@register("rollup_files", f"{BEFORE}, {oracle.rollup_cte('files')} SELECT {ROLLUP} FROM rolled")
def rollup_files(spark, sf_dir):
    return projection.rollup_edges(*_placed_graph(spark, sf_dir), "files").drop(*KEYS)


@register(
    "rollup_members",
    f"""{BEFORE}, {oracle.rollup_cte('packages')},
    placed AS MATERIALIZED (SELECT e.id AS edge_id, evidence_ids, s.group_id AS sg, predicate, t.group_id AS tg
      FROM edges_before e JOIN grouped s ON source_id = s.id JOIN grouped t ON target_id = t.id
      WHERE quality = 'exact' AND s.group_id <> t.group_id)
    SELECT r.id, edge_id, unnest(string_split(evidence_ids, ',')) AS evidence_id
    FROM placed JOIN rolled r
      ON sg = source_group_id AND tg = target_group_id AND placed.predicate = r.predicate""",
)
def rollup_members(spark, sf_dir):
    return projection.rollup_members(*_placed_graph(spark, sf_dir), "packages").drop(*KEYS)


@register(
    "rollup_evidence_counts",
    f"""{BEFORE}, {oracle.rollup_cte('packages')},
    placed AS (SELECT e.id AS edge_id, unnest(string_split(evidence_ids, ',')) AS evidence_id,
        s.group_id AS sg, predicate, t.group_id AS tg
      FROM edges_before e JOIN grouped s ON source_id = s.id JOIN grouped t ON target_id = t.id
      WHERE quality = 'exact' AND s.group_id <> t.group_id)
    SELECT r.id, count(DISTINCT edge_id) AS relation_count,
           count(DISTINCT evidence_id) AS evidence_count
    FROM placed JOIN rolled r
      ON sg = source_group_id AND tg = target_group_id AND placed.predicate = r.predicate
    GROUP BY r.id""",
)
def rollup_evidence_counts(spark, sf_dir):
    return projection.rollup_evidence_counts(*_placed_graph(spark, sf_dir), "packages").drop(*KEYS)


VISIBLE_FILES = """seen AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY path, id) AS n
  FROM nodes_before WHERE kind = 'FILE') WHERE n <= 500)"""


@register(
    "project_files",
    f"""{BEFORE}, {VISIBLE_FILES},
    {oracle.rollup_cte('files', visible="s.group_id IN (SELECT id FROM seen) AND t.group_id IN (SELECT id FROM seen)")}
    SELECT * FROM (SELECT {ROLLUP}, {RANKED} FROM rolled) WHERE position <= 1000""",
)
def project_files(spark, sf_dir):
    view = projection.project(*_placed_graph(spark, sf_dir), "files")["edges"]
    return view.drop(*KEYS).withColumn("position", F.col("position").cast("bigint"))


SEEN_SYMBOLS = """seen AS (SELECT id FROM (
  SELECT id, row_number() OVER (ORDER BY path, start_line, id) AS n
  FROM nodes_before WHERE kind = 'FUNCTION') WHERE n <= 5000)"""
SYMBOL_EDGES = f"""{BEFORE}, {SEEN_SYMBOLS},
    eligible AS (SELECT id, row_number() OVER (ORDER BY id) AS position FROM edges_before
      WHERE source_id IN (SELECT id FROM seen) AND target_id IN (SELECT id FROM seen))"""


@register(
    "project_symbols", f"{SYMBOL_EDGES} SELECT id, position FROM eligible WHERE position <= 1000"
)
def project_symbols(spark, sf_dir):
    view = projection.project(
        *_graph(spark, sf_dir), "symbols", node_budget=5000, include_inferred=True
    )
    return view["edges"].select("id", F.col("position").cast("bigint").alias("position"))


@register(
    "project_totals",
    f"""{SYMBOL_EDGES}, n AS (SELECT count(*) AS total_node_count FROM nodes_before
      WHERE kind = 'FUNCTION'), e AS (SELECT count(*) AS total_edge_count FROM eligible)
    SELECT total_node_count, total_edge_count, least(total_node_count, 5000) AS returned_nodes,
      least(total_edge_count, 1000) AS returned_edges,
      total_node_count > 5000 OR total_edge_count > 1000 AS truncated FROM n, e""",
)
def project_totals(spark, sf_dir):
    return projection.project(
        *_graph(spark, sf_dir), "symbols", node_budget=5000, include_inferred=True
    )["totals"].drop(*KEYS)


@register(
    "facets",
    f"{BEFORE} SELECT DISTINCT predicate FROM edges_before WHERE quality = 'exact'",
)
def facets(spark, sf_dir):
    edges = fixtures.trade_edges(spark, sf_dir)
    shown = projection.visible_edges(edges, ["CALLS", "IMPORTS", "INSTANTIATES"], False)
    return projection.facets(shown).drop(*KEYS)


# --- comparison -----------------------------------------------------------------------------

DIFF_NODES = """diff_nodes AS MATERIALIZED (
  SELECT coalesce(b.id, a.id) AS id, b.id IS NULL AS is_new, a.id IS NULL AS is_gone,
    concat_ws(',',
      CASE WHEN b.body_fingerprint IS DISTINCT FROM a.body_fingerprint
             OR b.is_test <> a.is_test OR b.is_entry_point <> a.is_entry_point
           THEN 'attributes' END,
      CASE WHEN b.content_hash <> a.content_hash THEN 'content_hash' END,
      CASE WHEN b.path <> a.path THEN 'path' END,
      CASE WHEN b.signature IS DISTINCT FROM a.signature THEN 'signature' END,
      CASE WHEN b.start_line IS DISTINCT FROM a.start_line THEN 'span' END) AS fields
  FROM nodes_before b FULL JOIN nodes_after a ON b.id = a.id)"""
CHANGED_NODES = """changed_nodes AS (
  SELECT id, CASE WHEN is_new THEN 'added' WHEN is_gone THEN 'removed' ELSE 'modified' END
    AS change, CASE WHEN is_new OR is_gone THEN '' ELSE fields END AS changed_fields
  FROM diff_nodes WHERE is_new OR is_gone OR fields <> '')"""


@register(
    "diff_nodes",
    f"{BOTH}, {DIFF_NODES}, {CHANGED_NODES} SELECT id, change, changed_fields FROM changed_nodes",
)
def diff_nodes(spark, sf_dir):
    before = fixtures.trade_nodes(spark, sf_dir, "before")
    after = fixtures.trade_nodes(spark, sf_dir, "after")
    return diff.node_changes(before, after).select(
        "id", "change", F.array_join("changed_fields", ",").alias("changed_fields")
    )


CHANGED_EDGES = """changed_edges AS MATERIALIZED (
  SELECT coalesce(b.id, a.id) AS id, coalesce(b.source_id, a.source_id) AS source_id,
    coalesce(b.predicate, a.predicate) AS predicate, coalesce(b.target_id, a.target_id) AS target_id,
    coalesce(b.quality, a.quality) AS quality,
    CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed'
         ELSE 'evidence_moved' END AS change
  FROM edges_before b FULL JOIN edges_after a ON b.id = a.id
  WHERE b.id IS NULL OR a.id IS NULL OR a.evidence_ids <> b.evidence_ids)"""


@register("diff_edges", f"{BOTH}, {CHANGED_EDGES} SELECT id, change FROM changed_edges")
def diff_edges(spark, sf_dir):
    before = fixtures.trade_edges(spark, sf_dir, "before")
    after = fixtures.trade_edges(spark, sf_dir, "after")
    return diff.edge_changes(before, after).select("id", "change")


@register(
    "evidence_moves",
    f"""{BOTH} SELECT b.id, b.evidence_ids AS before_ids, a.evidence_ids AS after_ids
    FROM edges_before b JOIN edges_after a ON b.id = a.id
    WHERE b.evidence_ids <> a.evidence_ids""",
)
def evidence_moves(spark, sf_dir):
    before = fixtures.trade_edges(spark, sf_dir, "before")
    after = fixtures.trade_edges(spark, sf_dir, "after")
    moved = diff.edge_changes(before, after).where(F.col("change") == "evidence_moved")
    return moved.select(
        "id", F.array_join("before.evidence.id", ",").alias("before_ids"),
        F.array_join("after.evidence.id", ",").alias("after_ids"),
    )


QUALITY = """removed_facts AS (SELECT source_id, predicate, target_id, max(id) AS id,
    arg_max(quality, id) AS quality FROM changed_edges WHERE change = 'removed' GROUP BY 1, 2, 3),
  added_facts AS (SELECT source_id, predicate, target_id, max(id) AS id,
    arg_max(quality, id) AS quality FROM changed_edges WHERE change = 'added' GROUP BY 1, 2, 3),
  quality AS (SELECT r.id AS before_edge_id, a.id AS after_edge_id, r.quality AS before_quality,
    a.quality AS after_quality FROM removed_facts r JOIN added_facts a
    USING (source_id, predicate, target_id) WHERE r.quality <> a.quality)"""


@register("diff_quality", f"{BOTH}, {CHANGED_EDGES}, {QUALITY} SELECT * FROM quality")
def diff_quality(spark, sf_dir):
    before = fixtures.trade_edges(spark, sf_dir, "before")
    after = fixtures.trade_edges(spark, sf_dir, "after")
    found = diff.quality_changes(diff.edge_changes(before, after))
    return found.select("before_edge_id", "after_edge_id", "before_quality", "after_quality")


# The reference rule, pair by pair inside one fingerprint: score, unique best on both sides.
RENAMES = """shaped AS (
  SELECT 'b' AS side, *, regexp_replace(signature, '^[^(]+', 'function') AS shape,
    nullif(regexp_extract(qualified_name, '^(.*)\\.[^.]*$', 1), '') AS owner
  FROM nodes_before WHERE id IN (SELECT id FROM diff_nodes WHERE is_gone)
  UNION ALL
  SELECT 'a', *, regexp_replace(signature, '^[^(]+', 'function'),
    nullif(regexp_extract(qualified_name, '^(.*)\\.[^.]*$', 1), '')
  FROM nodes_after WHERE id IN (SELECT id FROM diff_nodes WHERE is_new)),
  pairs AS (
  SELECT b.id AS before_node_id, a.id AS after_node_id,
    least(0.65::DOUBLE + CASE WHEN b.path = a.path THEN 0.15::DOUBLE ELSE 0 END
      + CASE WHEN b.shape = a.shape THEN 0.15::DOUBLE ELSE 0 END
      + CASE WHEN b.owner = a.owner THEN 0.05::DOUBLE ELSE 0 END, 1.0) AS score,
    concat_ws(',', 'body_fingerprint', CASE WHEN b.path = a.path THEN 'same_path' END,
      CASE WHEN b.shape = a.shape THEN 'signature_shape' END,
      CASE WHEN b.owner = a.owner THEN 'same_owner' END) AS matched_signals
  FROM shaped b JOIN shaped a ON b.side = 'b' AND a.side = 'a' AND b.kind = a.kind
    AND b.language IS NOT DISTINCT FROM a.language AND b.body_fingerprint = a.body_fingerprint),
  good AS (SELECT * FROM pairs WHERE score >= 0.8),
  ranked AS (SELECT *, max(score) OVER (PARTITION BY before_node_id) AS top_b,
    max(score) OVER (PARTITION BY after_node_id) AS top_a,
    count(*) OVER (PARTITION BY before_node_id, score) AS same_b,
    count(*) OVER (PARTITION BY after_node_id, score) AS same_a FROM good),
  renames AS (SELECT before_node_id, after_node_id, score, matched_signals FROM ranked
    WHERE score = top_b AND score = top_a AND same_b = 1 AND same_a = 1)"""


@register("renames", f"{BOTH}, {DIFF_NODES}, {RENAMES} SELECT * FROM renames")
def renames(spark, sf_dir):
    # Stored with what a match reads, as both sides of it are read off the changes.
    changes = cut(diff.node_changes(
        fixtures.trade_nodes(spark, sf_dir, "before"), fixtures.trade_nodes(spark, sf_dir, "after"), diff.matched_columns()
    ))
    found = diff.match_renames(
        changes.where(F.col("change") == "removed").select("before.*"),
        changes.where(F.col("change") == "added").select("after.*"),
    )
    return found.select(
        "before_node_id", "after_node_id", "score",
        F.array_join("matched_signals", ",").alias("matched_signals"),
    )


@register(
    "change_counts",
    f"""{BOTH}, {DIFF_NODES}, {CHANGED_NODES}, {RENAMES}, {CHANGED_EDGES}, {QUALITY},
    counted AS (
      SELECT 'added_nodes' AS record, count(*) AS amount FROM changed_nodes
        WHERE change = 'added' AND id NOT IN (SELECT after_node_id FROM renames)
      UNION ALL SELECT 'removed_nodes', count(*) FROM changed_nodes
        WHERE change = 'removed' AND id NOT IN (SELECT before_node_id FROM renames)
      UNION ALL SELECT 'modified_nodes', count(*) FROM changed_nodes WHERE change = 'modified'
      UNION ALL SELECT 'renamed_nodes', count(*) FROM renames
      UNION ALL SELECT 'added_edges', count(*) FROM changed_edges
        WHERE change = 'added' AND id NOT IN (SELECT after_edge_id FROM quality)
      UNION ALL SELECT 'removed_edges', count(*) FROM changed_edges
        WHERE change = 'removed' AND id NOT IN (SELECT before_edge_id FROM quality)
      UNION ALL SELECT 'evidence_moves', count(*) FROM changed_edges
        WHERE change = 'evidence_moved'
      UNION ALL SELECT 'quality_changes', count(*) FROM quality)
    SELECT * FROM counted WHERE amount > 0""",
)
def change_counts(spark, sf_dir):
    delta = diff.compare(
        *_graph(spark, sf_dir, "before"), *_graph(spark, sf_dir, "after"), with_cycles=False
    )
    return diff.change_counts(delta).drop("repository_id")


@register(
    "delta_verification",
    f"""{BOTH}, {DIFF_NODES}, {CHANGED_NODES}
    SELECT problem, count(*) AS amount FROM (
      SELECT unnest(['missing', 'not in comparison']) AS problem FROM changed_nodes
      WHERE change = 'modified' AND changed_fields LIKE '%signature%') GROUP BY problem""",
)
def delta_verification(spark, sf_dir):
    """A delta whose stored field lists lost ``signature`` does not verify."""

    changes = diff.node_changes(
        fixtures.trade_nodes(spark, sf_dir, "before"), fixtures.trade_nodes(spark, sf_dir, "after")
    )
    fresh = cut(
        changes.where(F.col("change") == "modified").select("repository_id", "id", "changed_fields")
    )
    stored = fresh.withColumn("changed_fields", F.array_remove("changed_fields", "signature"))
    found = diff.verify_delta({"modified_nodes": stored}, {"modified_nodes": fresh})
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("amount"))


# --- cycles ---------------------------------------------------------------------------------

CLOSURE = """reach(repository_id, a, b) AS (
    SELECT repository_id, source, target FROM steps
    UNION SELECT r.repository_id, r.a, s.target FROM reach r JOIN steps s
      ON r.repository_id = s.repository_id AND r.b = s.source),
  mutual AS (SELECT x.repository_id, x.a AS member, least(x.a, min(x.b)) AS cycle_id
    FROM reach x JOIN reach y ON x.repository_id = y.repository_id AND x.a = y.b AND x.b = y.a
    WHERE x.a <> x.b GROUP BY 1, 2)"""


def _steps(where: str) -> str:
    return f"""WITH RECURSIVE steps AS (
    SELECT DISTINCT 'day-' || strftime(ts, '%Y-%m-%d') AS repository_id,
      '' || user_id AS source, json_extract_string(props, '$.k') AS target
    FROM events WHERE event_type IN ('purchase', 'signup', 'click')
      AND '' || user_id <> json_extract_string(props, '$.k') AND {where}), {CLOSURE}"""


@register("cycles", f"{_steps('true')} SELECT repository_id, cycle_id, member FROM mutual")
def cycles(spark, sf_dir):
    return scc.cycles(fixtures.transitions(spark, sf_dir)).drop("revision_id")


NEW_CYCLES = (
    _steps("event_id % 4 <> 0")
    .replace("WITH RECURSIVE", "WITH RECURSIVE")
    .replace("steps", "old_steps").replace("reach", "old_reach").replace("mutual", "old_mutual")
    + ", "
    + _steps("true").replace("WITH RECURSIVE ", "")
)


@register(
    "new_cycles",
    f"""{NEW_CYCLES},
    old_sets AS (SELECT repository_id, string_agg(member, ',' ORDER BY member) AS members
      FROM old_mutual GROUP BY repository_id, cycle_id),
    new_sets AS (SELECT repository_id, cycle_id, string_agg(member, ',' ORDER BY member) AS members
      FROM mutual GROUP BY repository_id, cycle_id)
    SELECT repository_id, cycle_id FROM new_sets WHERE (repository_id, members) NOT IN
      (SELECT (repository_id, members) FROM old_sets)""",
)
def new_cycles(spark, sf_dir):
    edges = fixtures.transitions(spark, sf_dir)
    before = edges.where(F.col("event_id") % 4 != 0)
    return scc.new_cycles(scc.cycles(before), scc.cycles(edges))


WARNED = (
    _steps("event_id % 4 <> 0").replace("steps", "old_steps").replace("reach", "old_reach").replace("mutual", "old_mutual")
    + ", " + _steps("event_id % 9 <> 0 AND event_id % 5 <> 0").replace("WITH RECURSIVE ", ""))


@register(
    "structural_warnings",
    f"""{WARNED},
    old_sets AS (SELECT repository_id, string_agg(member, ',' ORDER BY member) AS members
      FROM old_mutual GROUP BY repository_id, cycle_id),
    new_sets AS (SELECT repository_id, cycle_id, string_agg(member, ',' ORDER BY member) AS members
      FROM mutual GROUP BY repository_id, cycle_id),
    fresh AS (SELECT repository_id, count(*) AS amount FROM new_sets
      WHERE (repository_id, members) NOT IN (SELECT (repository_id, members) FROM old_sets) GROUP BY 1),
    tests AS (SELECT event_id, 'day-' || strftime(ts, '%Y-%m-%d') AS repository_id, '' || user_id AS source,
        json_extract_string(props, '$.k') AS target, event_id % 4 <> 0 AS old,
        event_id % 9 <> 0 AS kept, event_id % 5 = 0 AS doubtful
      FROM events WHERE event_type = 'view' AND '' || user_id <> json_extract_string(props, '$.k')),
    gone AS (SELECT * FROM tests WHERE old AND (NOT kept OR doubtful)),
    come AS (SELECT repository_id, source, target, arg_max(doubtful, printf('%012d', event_id) || if(doubtful, 'i', '')) AS doubtful
      FROM tests WHERE kept AND (NOT old OR doubtful) GROUP BY ALL),
    last_gone AS (SELECT repository_id, source, target, max(event_id) AS event_id FROM gone GROUP BY ALL),
    doubted AS (SELECT event_id FROM last_gone JOIN come USING (repository_id, source, target) WHERE come.doubtful),
    lost AS (SELECT repository_id, count(*) AS amount FROM gone
      WHERE event_id NOT IN (SELECT event_id FROM doubted) GROUP BY 1)
    SELECT repository_id, amount || ' exact TESTS relation(s) were removed.' AS warning, amount FROM lost
    UNION ALL SELECT repository_id, amount || ' new exact dependency cycle(s) were introduced.', amount FROM fresh""",
)
def structural_warnings(spark, sf_dir):
    """Two revisions of the event graph: some edges go, some come, some are no longer exact."""

    edges = fixtures.transitions(spark, sf_dir).withColumns({
        "predicate": F.when(F.col("predicate") == "REFERENCES", "TESTS").otherwise(F.col("predicate")),
        "evidence": F.array(F.struct("id"))})
    doubtful = F.col("event_id") % 5 == 0
    before = cut(edges.where("event_id % 4 <> 0"))
    after = cut(edges.where("event_id % 9 <> 0").withColumns({
        "id": F.when(doubtful, F.concat("id", F.lit("i"))).otherwise(F.col("id")),
        "quality": F.when(doubtful, "inferred").otherwise(F.col("quality"))}))
    changes = cut(diff.edge_changes(before, after))
    return diff.structural_warnings(changes, diff.quality_changes(changes), before, after)


# --- digests --------------------------------------------------------------------------------

FILES = """WITH files AS (SELECT source AS repository_id, source || '/' || doc_id || '.txt' AS path,
    sha256(text) AS content_hash FROM documents),
  rows AS (SELECT *, printf('%08X', strlen(path)) || hex(encode(path)) || upper(content_hash)
    AS payload FROM files)"""


@register(
    "content_revision",
    f"""{FILES} SELECT repository_id,
      'content:' || sha256(unhex(string_agg(payload, '' ORDER BY path))) AS revision_id
    FROM rows GROUP BY repository_id""",
)
def content_revision(spark, sf_dir):
    return digest.content_revision(fixtures.document_files(spark, sf_dir), digest.linear_digest)


def _tree_sql() -> str:
    levels = f"""{FILES}, level0 AS (SELECT repository_id, sha256(path) AS bucket,
      sha256(unhex(payload)) AS digest FROM rows)"""
    for number, digits in enumerate(digest.TREE_DIGITS, start=1):
        levels += f""", level{number} AS (SELECT repository_id,
          substr(bucket, 1, {digits}) AS bucket,
          sha256(unhex(string_agg(digest, '' ORDER BY level{number - 1}.bucket))) AS digest
          FROM level{number - 1} GROUP BY repository_id, substr(bucket, 1, {digits}))"""
    last = len(digest.TREE_DIGITS)
    return f"{levels} SELECT repository_id, 'content:' || digest AS revision_id FROM level{last}"


@register("content_revision_tree", _tree_sql())
def content_revision_tree(spark, sf_dir):
    return digest.content_revision(fixtures.document_files(spark, sf_dir))


# --- checks ---------------------------------------------------------------------------------


@register(
    "graph_violations",
    f"""{BOTH}, refs AS (
      SELECT id, 'missing_node' AS rule, source_id AS node_id FROM edges_before
      UNION SELECT id, 'missing_node', target_id FROM edges_before
      UNION SELECT id, 'missing_owner', source_id FROM edges_before)
    SELECT DISTINCT rule, 'edge' AS record, id AS record_id FROM refs
    WHERE node_id NOT IN (SELECT id FROM nodes_after)""",
)
def graph_violations(spark, sf_dir):
    """Edges of one revision checked against the nodes of the next."""

    nodes = fixtures.trade_nodes(spark, sf_dir, "after").withColumn("revision_id", F.lit("mixed"))
    edges = fixtures.trade_edges(spark, sf_dir, "before").withColumn("revision_id", F.lit("mixed"))
    return validate.graph_violations(nodes, edges).drop(*KEYS)


@register(
    "record_violations",
    f"""{BEFORE}
    SELECT unnest(['exact_with_confidence']) AS rule, 'edge' AS record, id AS record_id
      FROM edges_before WHERE quality = 'exact'
    UNION ALL SELECT unnest(['missing_confidence', 'edge_identity_mismatch']), 'edge', id
      FROM edges_before WHERE quality = 'inferred' AND predicate = 'CALLS'
    UNION ALL SELECT unnest(['missing_span', 'node_identity_mismatch']), 'node', id
      FROM nodes_before WHERE kind = 'FUNCTION' AND is_test""",
)
def record_violations(spark, sf_dir):
    """Damaged rows: wrong confidence, renamed predicate, lost span, wrong path."""

    nodes, edges = _graph(spark, sf_dir)
    test = F.col("is_test") & (F.col("kind") == "FUNCTION")
    nodes = nodes.withColumn("span", F.when(~test, F.col("span"))).withColumn(
        "path", F.when(test, F.concat("path", F.lit("x"))).otherwise(F.col("path"))
    )
    calls = (F.col("quality") == "inferred") & (F.col("predicate") == "CALLS")
    edges = edges.withColumn(
        "confidence",
        F.when(F.col("quality") == "exact", F.lit(0.5)).when(~calls, F.col("confidence")),
    ).withColumn("predicate", F.when(calls, F.lit("LOADS")).otherwise(F.col("predicate")))
    found = validate.record_violations(nodes, edges).unionByName(
        validate.identity_violations(nodes, edges)
    )
    return found.drop(*KEYS)
