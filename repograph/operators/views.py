"""Product views of an answer: grounded nodes and edges, rollups and budgets.

``chunks`` and ``sources`` are the grounding cards of an answer, ``hops`` its budgeted
triplets with ``source_node`` and ``target_node``.  All of it is bounded per question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repograph import constants as K
from repograph.functions import envelope, ids, text

CARD = [
    "node_id", "logical_id", "path", "content_hash", "parser", "parser_version", "revision_id",
    "repository_id", "entity_kind", "span", "qualified_name", "language", "signature",
    "is_generated",
]
REQUIRED = ["node_id", "path", "content_hash", "parser", "parser_version", "revision_id"]


def grounding(chunks: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(question_id, key_kind, key, card): the first card that answers to each key."""

    base = chunks.select("question_id", F.lit(0).alias("list_no"), F.col("rank").alias("place"),
                         F.array("chunk_id").alias("chunk_ids"), F.struct(*CARD).alias("card"))
    if sources is not None:
        base = base.unionByName(sources.select(
            "question_id", F.lit(1).alias("list_no"), F.col("position").alias("place"), "chunk_ids",
            F.struct(*CARD).alias("card")))
    keyed = F.concat(
        F.transform("chunk_ids", lambda c: F.struct(F.lit("chunk").alias("key_kind"), c.alias("key"))),
        F.array(
            F.struct(F.lit("node").alias("key_kind"), F.col("card.node_id").alias("key")),
            F.struct(F.lit("logical").alias("key_kind"), F.col("card.logical_id").alias("key")),
        ),
    )
    rows = base.select("question_id", "list_no", "place", "card", F.inline(keyed))
    return rows.where(F.coalesce("key", F.lit("")) != "").groupBy("question_id", "key_kind", "key").agg(
        F.min_by("card", F.struct("list_no", "place")).alias("card")
    )


def ground_hops(hops: DataFrame, cards: DataFrame) -> DataFrame:
    """Hops with the card of each end: the relation's own chunk first for the source."""

    def lookup(df: DataFrame, kind: str, key: Column, name: str) -> DataFrame:
        found = cards.where(F.col("key_kind") == kind).select(
            "question_id", F.col("key").alias(f"{name}_key"), F.col("card").alias(name))
        return df.withColumn(f"{name}_key", key).join(
            found, ["question_id", f"{name}_key"], "left").drop(f"{name}_key")

    joined = lookup(hops, "chunk", F.col("relation.chunk_id"), "by_chunk")
    joined = lookup(joined, "node", F.col("source_node"), "source_by_node")
    joined = lookup(joined, "logical", F.col("source.identifier"), "source_by_logical")
    joined = lookup(joined, "node", F.col("target_node"), "target_by_node")
    joined = lookup(joined, "logical", F.col("target.identifier"), "target_by_logical")
    return (
        joined.withColumn("source_card", F.coalesce("by_chunk", "source_by_node", "source_by_logical"))
        .withColumn("target_card", F.coalesce("target_by_node", "target_by_logical"))
        .drop("by_chunk", "source_by_node", "source_by_logical", "target_by_node", "target_by_logical")
    )


def refusal(node: Column, card: Column, fallback_kind: Column) -> Column:
    """The first rule that keeps an end from being a node; null when it may be one."""

    missing = F.array_compact(F.array(*[
        F.when(F.coalesce(card[n].cast("string"), F.lit("")) == "", F.lit(n)) for n in REQUIRED
    ]))
    kind = F.upper(F.coalesce(F.nullif(card["entity_kind"], F.lit("")), fallback_kind, F.lit("")))
    return (
        F.when(card.isNull(), F.lit("no source card"))
        .when(F.coalesce(node, F.lit("")) == "", F.lit("no identifier"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
        .when(node != card["node_id"], F.lit("other node"))
        .when(~kind.isin(*K.CONTAINER_KINDS) & card["span"].isNull(), F.lit("no line span"))
        .when(~kind.isin(*K.NODE_KINDS), F.lit("invalid node"))
    )


def grounding_reasons(hops: DataFrame, cards: DataFrame) -> DataFrame:
    """Hops with ``source_refusal`` and ``target_refusal``."""

    return ground_hops(hops, cards).withColumns({
        "source_refusal": refusal(F.col("source_node"), F.col("source_card"), F.col("source.type")),
        "target_refusal": refusal(F.col("target_node"), F.col("target_card"), F.col("target.type")),
    })


def symbol_view(hops: DataFrame, cards: DataFrame) -> dict[str, DataFrame]:
    """Grounded ``nodes`` and ``edges`` in first-seen order, and ``omitted`` hops per question.

    A relation without a proven envelope keeps quality unknown.
    """

    known = grounding_reasons(hops, cards).withColumn("proven", envelope.valid_envelope(
        F.col("relation.context"), F.col("relation.origin")))
    fine = F.col("source_refusal").isNull() & F.col("target_refusal").isNull()
    predicate = F.coalesce(F.nullif("relation.predicate", F.lit("")), "relation.raw_predicate")
    has_edge = (
        fine & predicate.isin(*K.PREDICATES) & (F.col("source_node") != F.col("target_node"))
        & (F.coalesce("source_card.repository_id", F.lit("")) != "")
    )
    known = known.withColumn("fine", fine).withColumn("predicate", predicate).withColumn(
        "has_edge", F.coalesce(has_edge, F.lit(False)))
    order = F.struct("list", "group_rank", "hop")
    record = lambda side: F.struct(
        F.struct("list", "group_rank", "hop", F.lit(0 if side == "source" else 1).alias("end")).alias("seen"),
        F.col(f"{side}_node").alias("id"), F.col(f"{side}_card").alias("card"),
        F.col(f"{side}.type").alias("type"),
    )
    ends = known.where("fine").select("question_id", F.inline(F.array(record("source"), record("target"))))
    first = ends.groupBy("question_id", "id").agg(
        F.min("seen").alias("seen"), F.min_by(F.struct("card", "type"), "seen").alias("c"))
    place = Window.partitionBy("question_id").orderBy("seen")
    kind = F.upper(F.coalesce(F.nullif("c.card.entity_kind", F.lit("")), "c.type"))
    nodes = first.select(
        "question_id", F.row_number().over(place).alias("position"), "id",
        F.coalesce("c.card.logical_id", "id").alias("logical_id"), kind.alias("kind"),
        text.display_name(F.coalesce("c.card.qualified_name", "id"), F.col("c.card.path"), kind)
        .alias("display_name"), "c.card.qualified_name", "c.card.language", "c.card.path",
        "c.card.span", "c.card.signature", "c.card.revision_id", "c.card.content_hash",
        "c.card.parser", "c.card.parser_version", "c.card.is_generated", "c.card.repository_id",
    )
    context = F.col("relation.context")
    fallback = F.sha2(F.concat_ws(":", "source_node", "relation.predicate", "target_node"), 256)
    relation_id = F.coalesce(
        F.when(F.col("proven"), envelope.field(context, "edge_id")),
        F.nullif("relation.id", F.lit("")), fallback,
    )
    quality = F.when(F.col("proven"), "exact").otherwise("unknown")
    parsed = envelope.parse(context)
    evidence = F.when(F.col("proven"), F.array(parsed["evidence"])).otherwise(
        F.filter(F.array(parsed["evidence"]), lambda _: F.lit(False)))
    edge_rows = known.where("has_edge").withColumn("id", relation_id).select(
        "question_id", "id", order.alias("seen"), "source_node", "target_node", "predicate",
        quality.alias("quality"),
        F.when(F.col("proven"), F.lit(None)).otherwise(F.col("relation.confidence")).alias("confidence"),
        evidence.alias("evidence"),
        F.when(F.col("proven"), parsed["summary"]).otherwise(F.concat(
            F.lit("The returned relation context has no deterministic edge evidence: "),
            F.coalesce("relation.context", F.lit("This relationship was returned.")))).alias("context"),
        F.when(F.col("proven"), parsed["extractor"]).otherwise("context-graph").alias("extractor"),
        F.when(F.col("proven"), parsed["extractor_version"]).otherwise("v2").alias("extractor_version"),
        F.coalesce("source_card.revision_id", F.lit("current")).alias("revision_id"),
        F.coalesce("source_card.node_id", "source_node").alias("owner_source_id"),
        F.col("relation.origin").alias("origin"), F.col("relation.id").alias("relationship_id"),
        ids.edge_logical_id(F.col("source_card.repository_id"), F.col("source_node"),
                            F.col("predicate"), F.col("target_node"), quality).alias("logical_id"),
    )
    columns = [c for c in edge_rows.columns if c not in ("question_id", "id")]
    kept = edge_rows.groupBy("question_id", "id").agg(
        F.min_by(F.struct(*columns), "seen").alias("e")).select("question_id", "id", "e.*")
    edges = kept.withColumn("position", F.row_number().over(place)).withColumnsRenamed(
        {"source_node": "source_id", "target_node": "target_id"}).drop("seen")
    omitted = known.groupBy("question_id").agg(F.count_if(~F.col("has_edge")).alias("omitted_hops"))
    return {"nodes": nodes, "edges": edges, "omitted": omitted}


def view_rollup(nodes: DataFrame, edges: DataFrame, depth: str) -> dict[str, DataFrame]:
    """Exact edges between first path segments (``package``) or files (``file``).

    Unlike the graph rollup its evidence is a plain count over all contributing edges, and its
    ids name the groups by path.  ``nodes`` and ``edges`` carry a ``position``.  Contributors
    are rows of ``members`` and never one array.
    """

    path = text.group_path(F.col("path"), depth)
    digest = lambda value: F.substring(F.sha2(value, 256), 1, 24)
    placed = nodes.select(
        "question_id", F.col("id").alias("node_id"), path.alias("group_path"), "position",
        F.concat(F.lit(f"{depth}_"), digest(path)).alias("group_id"))
    groups = placed.groupBy("question_id", "group_id", "group_path").agg(
        F.min("position").alias("position"))
    side = lambda n: placed.select(
        "question_id", F.col("node_id").alias(f"{n}_id"), F.col("group_id").alias(f"{n}_group"))
    members = (
        edges.where(F.col("quality") == "exact")
        .select("question_id", F.col("id").alias("edge_id"), "source_id", "target_id", "predicate",
                "position", F.size("evidence").alias("evidence"))
        .join(side("source"), ["question_id", "source_id"])
        .join(side("target"), ["question_id", "target_id"])
        .where(F.col("source_group") != F.col("target_group"))
        .withColumn("id", F.concat(F.lit("aggregate_"), digest(
            F.concat_ws(":", "source_group", "predicate", "target_group"))))
    )
    aggregates = members.groupBy("question_id", "id", "source_group", "predicate", "target_group").agg(
        F.count(F.lit(1)).alias("exact_relation_count"), F.sum("evidence").alias("evidence_count"),
        F.min("position").alias("position"))
    return {
        "nodes": groups, "aggregates": aggregates,
        "members": members.select("question_id", "id", "edge_id", "position"),
    }


def budget_view(
    nodes: DataFrame, edges: DataFrame, max_nodes: int = 50, max_edges: int = 80
) -> dict[str, DataFrame]:
    """The first nodes of a view, then the first edges among them; ``budget`` per question."""

    if max_nodes < 1 or max_edges < 0:
        raise ValueError("view budgets must allow a node and no negative edges")
    place = Window.partitionBy("question_id").orderBy("position")
    shown = nodes.withColumn("place", F.row_number().over(place)).where(F.col("place") <= max_nodes)
    visible = shown.select("question_id", "id")
    eligible = edges.join(
        visible.withColumnRenamed("id", "source_id"), ["question_id", "source_id"], "left_semi"
    ).join(visible.withColumnRenamed("id", "target_id"), ["question_id", "target_id"], "left_semi")
    kept = eligible.withColumn("place", F.row_number().over(place)).where(F.col("place") <= max_edges)
    available = nodes.groupBy("question_id").agg(F.count(F.lit(1)).alias("available_nodes"))
    eligible_counts = eligible.groupBy("question_id").agg(F.count(F.lit(1)).alias("eligible_edges"))
    budget = available.join(eligible_counts, "question_id", "left").select(
        "question_id", F.least("available_nodes", F.lit(max_nodes)).alias("returned_nodes"),
        F.least(F.coalesce("eligible_edges", F.lit(0)), F.lit(max_edges)).alias("returned_edges"),
        ((F.col("available_nodes") > max_nodes)
         | (F.coalesce("eligible_edges", F.lit(0)) > max_edges)).alias("truncated"),
    )
    return {"nodes": shown.drop("place"), "edges": kept.drop("place"), "budget": budget}


def product_view(
    hops: DataFrame,
    cards: DataFrame,
    mode: str = "explore",
    depth: str = "symbol",
    max_nodes: int = 50,
    max_edges: int = 80,
) -> dict[str, DataFrame]:
    """The bounded view of each answer: symbols, or their rollup in repository mode."""

    symbols = symbol_view(hops, cards)
    nodes, edges = symbols["nodes"], symbols["edges"]
    if mode == "repository" and depth != "symbol":
        rolled = view_rollup(nodes, edges, depth)
        nodes = rolled["nodes"].withColumnRenamed("group_id", "id")
        edges = rolled["aggregates"].withColumnsRenamed(
            {"source_group": "source_id", "target_group": "target_id"})
    view = budget_view(nodes, edges, max_nodes, max_edges)
    shown = view["nodes"].groupBy("question_id").agg(F.count(F.lit(1)).alias("nodes"))
    diagnostics = symbols["omitted"].join(shown, "question_id", "left").select(
        "question_id", "omitted_hops", F.coalesce("nodes", F.lit(0)).alias("nodes"))
    diagnostics = diagnostics.withColumn("outcome", F.when(
        (F.col("nodes") == 0) & (F.col("omitted_hops") > 0), "hops_not_grounded"))
    return {**view, "diagnostics": diagnostics}


def explain(edges: DataFrame, question_id: str, edge_id: str) -> DataFrame:
    """One relation of a view with its explanation and evidence."""

    return edges.where((F.col("question_id") == question_id) & (F.col("id") == edge_id)).select(
        "question_id", "id", "source_id", "target_id", "predicate", "quality",
        F.col("context").alias("explanation"), "origin", "evidence")
