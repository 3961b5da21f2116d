"""Row types of the tables, as DDL text."""

from __future__ import annotations


SPAN = "STRUCT<start_line: INT, start_column: INT, end_line: INT, end_column: INT>"
EVIDENCE = (
    "STRUCT<id: STRING, path: STRING, start_line: INT, start_column: INT, end_line: INT, "
    "end_column: INT, excerpt_hash: STRING, explanation: STRING>"
)
NODES = (
    "repository_id STRING, revision_id STRING, id STRING, logical_id STRING, kind STRING, "
    "display_name STRING, qualified_name STRING, language STRING, path STRING, "
    f"span {SPAN}, signature STRING, content_hash STRING, parser STRING, "
    "parser_version STRING, is_generated BOOLEAN, body_fingerprint STRING, docstring STRING, "
    "is_test BOOLEAN, is_entry_point BOOLEAN, entry_reasons ARRAY<STRING>, "
    "attributes_json STRING"
)
EDGES = (
    "repository_id STRING, revision_id STRING, id STRING, logical_id STRING, "
    "source_id STRING, predicate STRING, target_id STRING, quality STRING, "
    "confidence DOUBLE, owner_source_id STRING, extractor STRING, extractor_version STRING, "
    f"attributes_json STRING, evidence ARRAY<{EVIDENCE}>"
)
ENTITY = (
    "STRUCT<identifier: STRING, entity_id: STRING, name: STRING, type: STRING, "
    "namespace: STRING>"
)
RELATION = (
    "STRUCT<id: STRING, predicate: STRING, raw_predicate: STRING, context: STRING, "
    "confidence: DOUBLE, origin: STRING, chunk_id: STRING>"
)
# The JSON form of one evidence record inside a relation context.
ENVELOPE = (
    "schema STRING, summary STRING, edge_id STRING, quality STRING, extractor STRING, "
    "extractor_version STRING, evidence STRUCT<id: STRING, evidence_id: STRING, path: STRING, "
    "start_line: INT, start_column: INT, end_line: INT, end_column: INT, "
    "excerpt_hash: STRING, explanation: STRING>"
)
GRAPH_JSON = (
    "graph_ir_version STRING, repository_id STRING, revision_id STRING, "
    "nodes ARRAY<STRUCT<id: STRING, logical_id: STRING, kind: STRING, display_name: STRING, "
    f"qualified_name: STRING, language: STRING, path: STRING, span: {SPAN}, "
    "signature: STRING, revision_id: STRING, content_hash: STRING, parser: STRING, "
    "parser_version: STRING, is_generated: BOOLEAN, attributes: STRING>>, "
    "edges ARRAY<STRUCT<id: STRING, logical_id: STRING, source_id: STRING, "
    "predicate: STRING, target_id: STRING, quality: STRING, confidence: DOUBLE, "
    f"evidence: ARRAY<{EVIDENCE}>, revision_id: STRING, extractor: STRING, "
    "extractor_version: STRING, owner_source_id: STRING, attributes: STRING>>, "
    "diagnostics ARRAY<STRING>"
)
