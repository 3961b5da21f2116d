"""Checks of graph tables; each returns one row per violation.

Columns: the keys, ``rule``, ``record`` (node or edge) and ``record_id``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph import constants as K
from repograph.functions import ids, text
from repograph.session import KEYS

HASH = "^[0-9a-f]{64}$"


def _blank(column: Column) -> Column:
    return F.coalesce(column, F.lit("")) == ""


def _rows(df: DataFrame, record: str, rules: dict[str, Column]) -> DataFrame:
    """One pass over a table: every broken rule of a row becomes a row."""

    broken = F.array_compact(
        F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(rule)) for rule, test in rules.items()])
    )
    return df.select(
        *KEYS, F.explode(broken).alias("rule"), F.lit(record).alias("record"),
        F.col("id").alias("record_id"),
    )


def record_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rules that one record breaks on its own."""

    kind, span = F.col("kind"), F.col("span")
    node_rules = {
        "unknown_kind": ~kind.isin(*K.NODE_KINDS) | kind.isNull(),
        "missing_span": kind.isin(*K.SPANNED_KINDS) & span.isNull(),
        "bad_span": span.isNotNull()
        & ~text.valid_span_order(
            span["start_line"], span["start_column"], span["end_line"], span["end_column"]
        ),
        "missing_path": (F.col("path") == ".") & ~kind.isin("REPOSITORY", *K.RECORD_KINDS),
        "bad_path": ~ids.normalize_path(F.col("path")).eqNullSafe(F.col("path")),
        "bad_content_hash": ~F.coalesce(F.col("content_hash").rlike(HASH), F.lit(False)),
        "blank_name": _blank(F.col("display_name")) | _blank(F.col("qualified_name")),
        "blank_parser": _blank(F.col("parser")) | _blank(F.col("parser_version")),
    }
    quality, confidence, evidence = F.col("quality"), F.col("confidence"), F.col("evidence")
    edge_rules = {
        "unknown_predicate": ~F.col("predicate").isin(*K.PREDICATES),
        "unknown_quality": ~quality.isin(*K.QUALITIES),
        "self_relation": F.col("source_id") == F.col("target_id"),
        "missing_evidence": quality.isin("exact", "inferred")
        & (F.coalesce(F.size(evidence), F.lit(0)) <= 0),
        "exact_with_confidence": (quality == "exact") & confidence.isNotNull(),
        "missing_confidence": quality.isin("inferred", "semantic") & confidence.isNull(),
        "confidence_out_of_range": (confidence < 0) | (confidence > 1),
        "bad_evidence_span": F.exists(evidence, lambda e: ~text.valid_evidence_span(e)),
        "bad_evidence_hash": F.exists(
            evidence, lambda e: ~F.coalesce(e["excerpt_hash"].rlike(HASH), F.lit(False))
        ),
        "bad_explanation": F.exists(
            evidence,
            lambda e: ~F.coalesce(F.length(e["explanation"]).between(1, 2000), F.lit(False)),
        ),
        "blank_extractor": _blank(F.col("extractor")) | _blank(F.col("extractor_version")),
    }
    return _rows(nodes, "node", node_rules).unionByName(_rows(edges, "edge", edge_rules))


def graph_violations(
    nodes: DataFrame, edges: DataFrame, revision_of: DataFrame | None = None
) -> DataFrame:
    """Duplicate ids, dangling endpoints and missing owners.

    ``revision_of`` (repository_id, revision_id) lists the revisions the graph should have.
    """

    def duplicates(df: DataFrame, record: str) -> DataFrame:
        return (
            df.groupBy(*KEYS, "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
            .select(*KEYS, F.lit("duplicate_id").alias("rule"), F.lit(record).alias("record"),
                    F.col("id").alias("record_id"))
        )

    known = nodes.select(*KEYS, F.col("id").alias("node_id")).distinct()
    refs = edges.select(
        *KEYS, "id",
        F.explode(
            F.array(
                F.struct(F.lit("missing_node").alias("rule"), F.col("source_id").alias("node_id")),
                F.struct(F.lit("missing_node").alias("rule"), F.col("target_id").alias("node_id")),
                F.struct(
                    F.lit("missing_owner").alias("rule"), F.col("owner_source_id").alias("node_id")
                ),
            )
        ).alias("ref"),
    ).select(*KEYS, "id", "ref.*")
    dangling = (
        refs.join(known, KEYS + ["node_id"], "left_anti")
        .select(*KEYS, "rule", F.lit("edge").alias("record"), F.col("id").alias("record_id"))
        .distinct()
    )
    found = duplicates(nodes, "node").unionByName(duplicates(edges, "edge")).unionByName(dangling)
    if revision_of is not None:
        for df, record in ((nodes, "node"), (edges, "edge")):
            foreign = df.join(revision_of.select(*KEYS).distinct(), KEYS, "left_anti")
            found = found.unionByName(
                foreign.select(*KEYS, F.lit("foreign_revision").alias("rule"),
                               F.lit(record).alias("record"), F.col("id").alias("record_id"))
            )
    return found


def identity_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that do not recompute from the fields they stand for."""

    logical = ids.node_logical_id(
        F.col("repository_id"), F.col("language"), F.col("path"), F.col("kind"),
        F.col("qualified_name"),
    )
    node_rules = {
        "node_id_mismatch": F.col("id") != ids.node_id(F.col("logical_id")),
        "node_identity_mismatch": (F.col("logical_id") != logical)
        & ~F.col("logical_id").startswith(F.concat(logical, F.lit(":"))),
    }
    edge_logical = ids.edge_logical_id(
        F.col("repository_id"), F.col("source_id"), F.col("predicate"), F.col("target_id"),
        F.col("quality"),
    )
    edge_rules = {
        "edge_identity_mismatch": (F.col("logical_id") != edge_logical)
        | (F.col("id") != ids.edge_id(edge_logical)),
        "evidence_id_mismatch": F.exists(
            "evidence",
            lambda e: e["id"]
            != ids.evidence_id(
                e["path"], e["start_line"], e["start_column"], e["end_line"], e["end_column"],
                e["excerpt_hash"],
            ),
        ),
    }
    return _rows(nodes, "node", node_rules).unionByName(_rows(edges, "edge", edge_rules))


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            record_violations(nodes, edges),
            graph_violations(nodes, edges),
            identity_violations(nodes, edges),
        ],
    )


def card_violations(
    cards: DataFrame,
    max_entities: int = K.MAX_ENTITIES_PER_CARD,
    max_relations: int = K.MAX_RELATIONS_PER_CARD,
    max_degree: int = K.MAX_DEGREE,
) -> DataFrame:
    """Cards whose own graph breaks a limit, or names an entity it does not hold.

    Works on exploded rows with partial counts, so a card of any size is only counted.
    """

    base = KEYS + ["source_id"]

    def found(df: DataFrame, rule: str) -> DataFrame:
        return df.select(*base, F.lit(rule).alias("rule")).distinct()

    ends = cards.select(*base, "entities", F.explode("relations").alias("r")).select(
        *base,
        F.explode(F.array("r.source", "r.target")).alias("handle"),
        F.map_contains_key("entities", F.col("r.source")).alias("has_source"),
        F.map_contains_key("entities", F.col("r.target")).alias("has_target"),
    )
    degrees = ends.groupBy(*base, "handle").agg(F.count(F.lit(1)).alias("degree"))
    return reduce(
        DataFrame.unionByName,
        [
            found(cards.where(F.size("entities") > max_entities), "too_many_entities"),
            found(
                cards.where(F.size("relations") > max_relations), "too_many_relations"
            ),
            found(ends.where(~F.col("has_source") | ~F.col("has_target")), "unknown_entity"),
            found(degrees.where(F.col("degree") > max_degree), "degree_exceeded"),
            found(
                cards.where(F.exists(F.map_values("entities"),
                                     lambda e: ~F.length(e["name"]).between(1, 256))),
                "bad_entity_name",
            ),
            found(
                cards.where(F.exists("relations",
                                     lambda r: F.length(r["context"]) > K.MAX_CONTEXT_CHARS)),
                "context_too_long",
            ),
        ],
    )
