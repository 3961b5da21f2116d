"""Shortest relation paths and the ordered flows of an answer.

A breadth-first search runs level by level as joins.  Each node keeps the smallest of the
edge-key sequences that reach it, which is the order in which a queue with sorted neighbours
would have found it; the sequence is at the same time the path itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repograph import constants as K
from repograph.functions import envelope, text
from repograph.session import cut

FLOW_ORIGIN = "assembled-flow"


def predicate_rank(predicate: Column) -> Column:
    ranks = F.lit(None).cast("int")
    for number, name in reversed(
        list(enumerate(K.FLOW_PREDICATES + K.FLOW_FALLBACK_PREDICATES))
    ):
        ranks = F.when(predicate == name, F.lit(number)).otherwise(ranks)
    return ranks


def reach_paths(
    edges: DataFrame,
    anchors: DataFrame,
    keys: list[str],
    max_hops: int,
    targets: DataFrame | None = None,
) -> DataFrame:
    """(keys, anchor, node, path) with the shortest path from each anchor to each node.

    ``edges`` has (keys, source, target, predicate, relation_id, order_no); ``anchors`` has
    (keys, anchor).  With ``targets`` (keys, anchor, node) only those nodes are returned and a
    search ends once its anchor has no node left to find.
    """

    steps = edges.select(
        *keys, "source",
        F.struct(
            predicate_rank(F.col("predicate")).alias("rank"), "target", "relation_id", "order_no",
            "source", "predicate",
        ).alias("step"),
    ).where(F.col("step.rank").isNotNull() & (F.col("source") != F.col("step.target")))
    steps = cut(steps)
    step_type = steps.schema["step"].dataType.simpleString()
    frontier = anchors.select(*keys, "anchor").distinct().withColumn(
        "node", F.col("anchor")
    ).withColumn("path", F.array().cast(f"array<{step_type}>"))
    here = keys + ["anchor", "node"]
    visited = frontier.select(*here)
    open_targets = targets
    found = []
    for _ in range(max_hops):
        grown = (
            frontier.withColumnRenamed("node", "source")
            .join(steps, keys + ["source"])
            .select(*keys, "anchor", F.col("step.target").alias("node"),
                    F.concat("path", F.array("step")).alias("path"))
            .join(visited, here, "left_anti")
            .groupBy(*here)
            .agg(F.min("path").alias("path"))
        )
        level = cut(grown)
        if level.isEmpty():
            break
        found.append(level)
        visited = visited.unionByName(level.select(*here))
        frontier = level
        if open_targets is not None:
            open_targets = cut(open_targets.join(level.select(*here), here, "left_anti"))
            frontier = frontier.join(
                open_targets.select(*keys, "anchor").distinct(), keys + ["anchor"], "left_semi"
            )
    if not found:
        return frontier.limit(0)
    result = found[0]
    for level in found[1:]:
        result = result.unionByName(level)
    if targets is not None:
        result = result.join(targets.select(*here).distinct(), here, "left_semi")
    return result


def shortest_paths(
    edges: DataFrame,
    pairs: DataFrame,
    keys: list[str],
    max_hops: int = 8,
    predicates: list[str] | None = None,
) -> DataFrame:
    """Fewest-hop path of every (keys, anchor, target) pair that has one.

    Returns (keys, anchor, target, hops, path).
    """

    kept = edges.where(F.col("predicate").isin(*(predicates or K.FLOW_PREDICATES)))
    wanted = pairs.where(F.col("anchor") != F.col("target")).select(
        *keys, "anchor", F.col("target").alias("node")
    )
    found = reach_paths(kept, pairs, keys, max_hops, cut(wanted.distinct()))
    return found.select(
        *keys, "anchor", F.col("node").alias("target"), F.size("path").alias("hops"), "path"
    )


def flow_edges(triplets: DataFrame) -> DataFrame:
    """Edges that a flow may follow, in the order in which the answer lists them."""

    allowed = K.FLOW_PREDICATES + K.FLOW_FALLBACK_PREDICATES
    order = Window.partitionBy("question_id").orderBy("list", "group_rank", "hop")
    name = F.upper(F.trim(F.coalesce(
        F.nullif("relation.predicate", F.lit("")), "relation.raw_predicate"
    )))
    return (
        triplets.withColumn("predicate", name)
        .where(
            F.col("predicate").isin(*allowed)
            & (F.col("source_node") != "") & (F.col("target_node") != "")
            & (F.col("source_node") != F.col("target_node"))
        )
        .select(
            "question_id", F.col("source_node").alias("source"),
            F.col("target_node").alias("target"), "predicate",
            F.coalesce("relation.id", F.lit("")).alias("relation_id"),
            F.coalesce("relation.chunk_id", F.lit("")).alias("chunk_id"),
            F.row_number().over(order).alias("order_no"),
            F.col("source").alias("source_entity"), F.col("target").alias("target_entity"),
            "relation",
        )
    )


def chunk_facts(chunks: DataFrame) -> DataFrame:
    """(question_id, node, rank, is_test, is_entry_point) of the first chunk of each node."""

    from repograph.operators.answer import node_lookup

    lookup = node_lookup(chunks).select(
        "question_id", F.col("key").alias("logical_id"), F.col("node_id").alias("known")
    )
    own = F.nullif("node_id", F.lit(""))
    return (
        chunks.select("question_id", "rank", "node_id", "logical_id", "is_test", "is_entry_point")
        .join(lookup, ["question_id", "logical_id"], "left")
        .withColumn("node", F.coalesce(own, "known", F.nullif("logical_id", F.lit(""))))
        .where(F.col("node").isNotNull())
        .groupBy("question_id", "node")
        .agg(
            F.min("rank").alias("rank"),
            F.min_by(text.truthy(F.col("is_test")), "rank").alias("is_test"),
            F.min_by(text.truthy(F.col("is_entry_point")), "rank").alias("is_entry_point"),
        )
    )


def anchors_and_targets(chunks: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where a flow may start and end, each (question_id, node, rank), best rank first.

    Both come from nodes that are no tests, if there are any.  A flow starts at entry points,
    else at nodes that no primary relation reaches, else anywhere.
    """

    key = ["question_id"]
    ends = edges.select(*key, F.col("source").alias("node")).union(
        edges.select(*key, F.col("target").alias("node"))
    ).distinct()
    charted = chunk_facts(chunks).join(ends, key + ["node"], "left_semi")
    reached = (
        edges.where(F.col("predicate").isin(*K.FLOW_PREDICATES))
        .select(*key, F.col("target").alias("node")).distinct().withColumn("reached", F.lit(True))
    )
    whole = Window.partitionBy(*key)
    pool = (
        charted.withColumn("some_code", F.bool_or(~F.col("is_test")).over(whole))
        .where(~F.col("some_code") | ~F.col("is_test"))
        .join(reached, key + ["node"], "left")
        .withColumn("root", F.col("reached").isNull())
        .withColumn("some_entry", F.bool_or("is_entry_point").over(whole))
        .withColumn("some_root", F.bool_or("root").over(whole))
    )
    start = (
        F.when(F.col("some_entry"), F.col("is_entry_point"))
        .when(F.col("some_root"), F.col("root"))
        .otherwise(F.lit(True))
    )
    targets = pool.select(*key, "node", "rank")
    return pool.where(start).select(*key, "node", "rank"), targets


def _entity_text(entity: Column, fallback: Column) -> Column:
    shown = [F.nullif(F.trim(entity[n]), F.lit("")) for n in ("name", "identifier", "entity_id")]
    return F.coalesce(*shown, fallback)


def _step_text() -> Column:
    context = F.col("relation.context")
    summary = F.when(
        envelope.is_exact_envelope(context),
        F.nullif(F.trim(envelope.field(context, "summary")), F.lit("")),
    )
    pair = F.concat_ws(
        " ", _entity_text(F.col("source_entity"), F.col("source")), F.col("predicate"),
        _entity_text(F.col("target_entity"), F.col("target")),
    )
    return F.coalesce(summary, pair)


def assemble_flows(
    chunks: DataFrame,
    triplets: DataFrame,
    max_paths: int = 3,
    max_hops: int = 8,
    min_hops: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """Order grounded relations into at most ``max_paths`` flows per question.

    Targets in rank order, anchors in rank order; primary predicates first, imports only when
    no primary path exists; a path inside an accepted one is left out.  ``triplets`` carry
    ``source_node`` and ``target_node``.  Returns (groups, triplets).
    """

    key = ["question_id"]
    edges = cut(flow_edges(triplets))
    starts, targets = anchors_and_targets(chunks, edges)
    starts = cut(starts)
    anchors = starts.select(*key, F.col("node").alias("anchor"))
    primary = reach_paths(
        edges.where(F.col("predicate").isin(*K.FLOW_PREDICATES)), anchors, key, max_hops
    )
    wider = reach_paths(edges, anchors, key, max_hops)
    spare = wider.join(primary.select(*key, "anchor", "node"), key + ["anchor", "node"], "left_anti")
    candidates = (
        primary.unionByName(spare)
        .where(F.size("path") >= min_hops)
        .join(targets.withColumnRenamed("rank", "target_rank"), key + ["node"])
        .join(starts.select(*key, F.col("node").alias("anchor"), F.col("rank").alias("anchor_rank")),
              key + ["anchor"])
    )
    marks = F.transform(
        "path",
        lambda s: F.concat_ws("\x1f", s["source"], s["predicate"], s["target"], s["relation_id"]),
    )
    ordered = candidates.select(
        *key,
        F.struct(
            "target_rank", "node", "anchor_rank", "anchor",
            F.array_distinct(marks).alias("marks"),
            F.transform("path", lambda s: s["order_no"]).alias("steps"),
        ).alias("flow"),
    )
    flow_type = ordered.schema["flow"].dataType.simpleString()

    def accept(done: Column, flow: Column) -> Column:
        inside = F.exists(done, lambda d: F.size(F.array_except(flow["marks"], d["marks"])) == 0)
        return F.when((F.size(done) >= max_paths) | inside, done).otherwise(
            F.concat(done, F.array(flow))
        )

    # At most one candidate per pair of chunks of one answer, so the list is short.
    chosen = ordered.groupBy(*key).agg(F.array_sort(F.collect_list("flow")).alias("flows")).select(
        *key,
        F.posexplode(
            F.aggregate("flows", F.array().cast(f"array<{flow_type}>"), accept)
        ).alias("place", "flow"),
    )
    hops = (
        chosen.select(
            *key, F.lit("path").alias("list"), (F.col("place") + 1).alias("group_rank"),
            F.size("flow.steps").alias("length"), F.posexplode("flow.steps").alias("at", "order_no"),
        )
        .withColumn("hop", F.col("at") + 1)
        .join(edges, key + ["order_no"])
    )
    hops = cut(hops.withColumn("step_text", _step_text()))
    part = F.array_sort(F.collect_list(F.struct("hop", "step_text", "chunk_id", "relation_id",
                                                "source", "predicate", "target")))
    listed = hops.groupBy(*key, "list", "group_rank").agg(part.alias("h"))
    summary = F.array_join(
        F.transform("h", lambda x: F.concat(x["hop"].cast("string"), F.lit(". "), x["step_text"])),
        "\n",
    )
    identity = F.array_join(
        F.transform(
            "h", lambda x: F.concat_ws(">", x["relation_id"], x["source"], x["predicate"], x["target"])
        ),
        "|",
    )
    cited = F.array_distinct(
        F.filter(F.transform("h", lambda x: x["chunk_id"]), lambda c: c != "")
    )
    groups = listed.select(
        *key, "list", "group_rank",
        F.concat(F.lit("flow_"), F.substring(F.sha2(identity, 256), 1, 24)).alias("group_id"),
        F.lit(None).cast("double").alias("score"), summary.alias("summary"),
        cited.alias("source_chunk_ids"), F.lit(FLOW_ORIGIN).alias("origin"),
    )
    rows = hops.select(
        *key, "list", "group_rank", "hop", F.col("source_entity").alias("source"),
        F.col("target_entity").alias("target"), "relation", F.col("source").alias("source_node"),
        F.col("target").alias("target_node"),
        F.when(F.col("hop") == 1, "entry").otherwise("step").alias("source_role"),
        F.when(F.col("hop") == F.col("length"), "target").otherwise("step").alias("target_role"),
    )
    return groups, rows


def is_connected(edges: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, connected): the members of each small selection hang together.

    ``edges`` (keys, source, target) are read both ways; ``members`` has (keys, node).  Used
    for saved paths of at most 25 entities, so 24 rounds always suffice.
    """

    both = edges.select(*keys, "source", "target").unionByName(
        edges.select(*keys, F.col("target").alias("source"), F.col("source").alias("target"))
    )
    both = cut(both.distinct())
    labels = cut(members.select(*keys, "node").distinct().withColumn("label", F.col("node")))
    while True:
        offered = (
            labels.withColumnRenamed("node", "source").join(both, keys + ["source"])
            .groupBy(*keys, F.col("target").alias("node")).agg(F.min("label").alias("offer"))
        )
        merged = cut(
            labels.join(offered, keys + ["node"], "left").select(
                *keys, "node", F.least("label", F.coalesce("offer", "label")).alias("label"),
                F.coalesce(F.col("offer") < F.col("label"), F.lit(False)).alias("moved"),
            )
        )
        labels = merged.select(*keys, "node", "label")
        if merged.where("moved").isEmpty():
            break
    return labels.groupBy(*keys).agg((F.min("label") == F.max("label")).alias("connected"))


def lens_selection(hops: DataFrame) -> DataFrame:
    """The first path of each question whose hops are all exact and chained.

    Paths of over 24 hops are no candidates; nothing is cut off.

    ``hops`` has (question_id, group_rank, hop, source_node, target_node, edge_id or null).
    Returns its hops with ``is_anchor_source`` and ``is_anchor_target`` at the two ends.
    """

    path = Window.partitionBy("question_id", "group_rank").orderBy("hop")
    linked = hops.withColumn("before", F.lag("target_node").over(path)).withColumn(
        "fine",
        F.col("edge_id").isNotNull()
        & F.coalesce(F.col("before") == F.col("source_node"), F.lit(True)),
    )
    good = (
        linked.groupBy("question_id", "group_rank")
        .agg(F.bool_and("fine").alias("fine"), F.max("hop").alias("last"))
        .where(F.col("fine") & (F.col("last") <= K.MAX_LENS_HOPS))
        .groupBy("question_id")
        .agg(F.min(F.struct("group_rank", "last")).alias("g"))
        .select("question_id", "g.*")
    )
    return hops.join(good, ["question_id", "group_rank"]).select(
        "question_id", "group_rank", "hop", "source_node", "target_node", "edge_id",
        (F.col("hop") == 1).alias("is_anchor_source"),
        (F.col("hop") == F.col("last")).alias("is_anchor_target"),
    )
