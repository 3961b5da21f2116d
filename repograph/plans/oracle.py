"""The same fixture tables and results as plain SQL, for the side-by-side check."""

from __future__ import annotations


def sid(prefix: str, text: str) -> str:
    return f"'{prefix}_' || substr(sha256({text}), 1, 24)"


PLACES = """places AS (
  SELECT n_nationkey, r_name, r_name || '/' || n_name AS nation_path
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def orders_cte(revision: str) -> str:
    missing = 0 if revision == "before" else 1
    name = "'o' || o_orderkey"
    if revision == "after":
        name = f"CASE WHEN o_orderkey % 13 = 0 THEN {name} || '_v2' ELSE {name} END"
    return f"""orders_{revision} AS (
  SELECT *, replace(path, '/', '.') || '.' || name AS qualified_name FROM (
    SELECT o_orderkey, o_custkey, o_orderpriority,
           nation_path || '/c' || o_custkey AS path, {name} AS name
    FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN places ON c_nationkey = n_nationkey WHERE o_orderkey % 10 <> {missing}))"""


SUPPLY = """supply AS (
  SELECT s_suppkey, nation_path || '/s' || s_suppkey AS path
  FROM supplier JOIN places ON s_nationkey = n_nationkey)"""


def nodes_cte(revision: str) -> str:
    after = revision == "after"
    moved = "CASE WHEN o_orderkey % 17 = 0 THEN '2' ELSE '1' END" if after else "'1'"
    signature = "name || '(customer, total)'"
    if after:
        signature = (
            "name || CASE WHEN o_orderkey % 7 = 0 THEN '(customer, total, note)' "
            "ELSE '(customer, total)' END"
        )
    logical = (
        "'repo:trade:' || coalesce(language, 'none') || ':' || path || ':' || lower(kind) || ':' "
        "|| qualified_name"
    )
    return f"""nodes_{revision} AS MATERIALIZED (
  SELECT *, {sid('node', logical)} AS id, {logical} AS logical_id FROM (
    SELECT 'REPOSITORY' AS kind, 'trade' AS display_name, 'trade' AS qualified_name,
           NULL AS language, '.' AS path, NULL AS start_line, NULL AS signature,
           sha256('.') AS content_hash, NULL AS body_fingerprint, false AS is_test,
           false AS is_entry_point
    UNION ALL
    SELECT 'PACKAGE', split_part(path, '/', -1), replace(path, '/', '.'), NULL, path, NULL, NULL,
           sha256(path), NULL, false, false
    FROM (SELECT DISTINCT r_name AS path FROM places UNION ALL SELECT nation_path FROM places)
    UNION ALL
    SELECT 'FILE', split_part(path, '/', -1), replace(path, '/', '.'), 'python', path, NULL, NULL,
           sha256(path), NULL, false, false
    FROM (SELECT nation_path || '/c' || c_custkey AS path FROM customer
          JOIN places ON c_nationkey = n_nationkey UNION ALL SELECT path FROM supply)
    UNION ALL
    SELECT 'FUNCTION', name, qualified_name, 'python', path, 1 + o_orderkey % 1000000000,
           {signature},
           sha256('order:' || o_orderkey || ':' || o_orderpriority || ':' || {moved}),
           sha256('body:' || CASE WHEN o_orderkey % 5 = 0 THEN 'c' || o_custkey
                             ELSE '' || o_orderkey END),
           o_orderkey % 19 = 0, o_orderkey % 23 = 0
    FROM orders_{revision}
    UNION ALL
    SELECT 'FUNCTION', 'p' || l_partkey, replace(path, '/', '.') || '.p' || l_partkey, 'python',
           path, 1 + l_partkey % 1000000000, 'p' || l_partkey || '(supplier)',
           sha256('part:' || l_suppkey || ':' || l_partkey),
           sha256('body:p:' || l_suppkey || ':' || l_partkey), false, false
    FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supply
      ON l_suppkey = s_suppkey))"""


def edges_cte(revision: str) -> str:
    exact = "l_linestatus = 'F'"
    if revision == "after":
        exact = f"CASE WHEN l_orderkey % 11 = 0 THEN NOT ({exact}) ELSE {exact} END"
    source = "'repo:trade:python:' || o.path || ':function:' || o.qualified_name"
    target = (
        "'repo:trade:python:' || s.path || ':function:' || replace(s.path, '/', '.') || '.p' "
        "|| l_partkey"
    )
    excerpt = (
        "sha256(l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey)"
    )
    line = "(1 + l_orderkey % 1000000000)"
    if revision == "after":
        line = "(1 + l_orderkey % 1000000000 + CASE WHEN l_orderkey % 29 = 0 THEN 1 ELSE 0 END)"
    place = f"o.path || ':' || {line} || ':' || l_linenumber || ':' || {line} || ':80:' || {excerpt}"
    edge = "'repo:trade:' || source_id || ':' || predicate || ':' || target_id || ':' || quality"
    return f"""lines_{revision} AS MATERIALIZED (
  SELECT {sid('node', source)} AS source_id, {sid('node', target)} AS target_id,
         CASE l_returnflag WHEN 'N' THEN 'CALLS' WHEN 'A' THEN 'INSTANTIATES'
              ELSE 'IMPORTS' END AS predicate, o.path, {line} AS line, l_linenumber,
         {excerpt} AS excerpt_hash, 'o' || l_orderkey || ' uses p' || l_partkey || '.' AS explanation,
         CASE WHEN {exact} THEN 'exact' ELSE 'inferred' END AS quality, l_discount,
         {sid('evidence', place)} AS evidence_id
  FROM lineitem JOIN orders_{revision} o ON l_orderkey = o_orderkey
  JOIN supply s ON l_suppkey = s_suppkey),
edges_{revision} AS MATERIALIZED (
  SELECT *, {sid('edge', edge)} AS id, {edge} AS logical_id FROM (
    SELECT source_id, predicate, target_id, quality,
           CASE WHEN quality = 'inferred' THEN min(l_discount) END AS confidence,
           string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) AS evidence_ids,
           count(DISTINCT evidence_id) AS evidence_count,
           arg_min({{'path': path, 'line': line, 'n': l_linenumber, 'hash': excerpt_hash,
             'id': evidence_id, 'said': explanation}}, evidence_id) AS first_evidence
    FROM lines_{revision} GROUP BY source_id, predicate, target_id, quality))"""


def graph(*revisions: str) -> str:
    """The WITH clause of the trade graph."""

    parts = [PLACES, SUPPLY]
    for revision in revisions:
        parts += [orders_cte(revision), nodes_cte(revision), edges_cte(revision)]
    return "WITH " + ",\n".join(parts)


def groups_cte(depth: str, revision: str = "before") -> str:
    if depth == "files":
        return f"""grouped AS MATERIALIZED (
  SELECT n.id, f.id AS group_id FROM nodes_{revision} n
  JOIN nodes_{revision} f ON f.kind = 'FILE' AND f.path = n.path)"""
    return f"""packages AS MATERIALIZED (SELECT path, id FROM nodes_{revision} WHERE kind = 'PACKAGE'),
grouped AS MATERIALIZED (
  SELECT n.id, arg_max(p.id, length(p.path)) AS group_id
  FROM nodes_{revision} n JOIN packages p
    ON n.kind <> 'PACKAGE' AND starts_with(n.path, p.path || '/')
  GROUP BY n.id
  UNION ALL SELECT id, id FROM packages)"""


def rollup_cte(depth: str, revision: str = "before", visible: str = "") -> str:
    where = f"AND {visible}" if visible else ""
    aggregate = sid(
        "aggregate",
        f"'trade:{depth}:' || source_group_id || ':' || predicate || ':' || target_group_id",
    )
    return f"""{groups_cte(depth, revision)},
rolled AS MATERIALIZED (
  SELECT *, {aggregate} AS id FROM (
    SELECT s.group_id AS source_group_id, predicate, t.group_id AS target_group_id,
           count(*) AS exact_relation_count
    FROM edges_{revision} e JOIN grouped s ON e.source_id = s.id
    JOIN grouped t ON e.target_id = t.id
    WHERE quality = 'exact' AND s.group_id <> t.group_id {where}
    GROUP BY 1, 2, 3))"""
