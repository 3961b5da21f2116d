"""From ranked chunks and relation groups to a grounded, bounded answer per question.

Tables: ``chunks`` (question_id, rank, chunk_id, ...), ``groups`` (question_id, list,
group_rank, group_id, score, summary, source_chunk_ids, origin) and ``triplets``
(question_id, list, group_rank, hop, source, target, relation).  ``list`` is path or relation.
An answer holds at most 50 + 12 + 20 chunks and the relations read for 12 of them, so windows
per question are short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repograph import constants as K
from repograph.functions import envelope, text
from repograph.operators import paths
from repograph.operators.retrieval import dedupe_ranked
from repograph.session import cut

GROUP = ["question_id", "list", "group_rank"]
#: What the steps of an answer read of its chunks.
CHUNK_STEPS = ["question_id", "rank", "chunk_id", "source_id", "node_id", "logical_id", "is_test", "is_entry_point"]


def budget_context(chunks: DataFrame, limit: int, order: list[str] | None = None) -> DataFrame:
    """Clip contents to a character budget per question; no chunk is dropped."""

    before = (
        Window.partitionBy("question_id").orderBy(*(order or ["rank"]))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    size = F.length(F.coalesce("content", F.lit("")))
    used = F.coalesce(F.sum(size).over(before), F.lit(0))
    left = F.greatest(F.lit(limit) - used, F.lit(0)).cast("int")
    return (
        chunks.withColumn("left", left)
        .withColumn("content_truncated", size > F.col("left"))
        .withColumn("content", F.substr(F.coalesce("content", F.lit("")), F.lit(1), F.col("left")))
        .drop("left")
    )


def budget_hops(
    triplets: DataFrame,
    group_limit: int,
    hop_limit: Column | int,
    per_group: int | None = None,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Keep the first hops of the first groups within the budgets.

    ``triplets`` has (question_id, group_rank, hop, ...); ranks need not be dense.  With
    ``groups`` a group without hops takes a place, too.
    """

    per_question = Window.partitionBy("question_id").orderBy("group_rank")
    # The budget may differ per question, so it joins the group rows before it is used.
    sizes = (
        triplets.withColumn("hop_budget", F.lit(hop_limit) if isinstance(hop_limit, int) else hop_limit)
        .groupBy("question_id", "group_rank")
        .agg(F.count(F.lit(1)).alias("hops"), F.first("hop_budget").alias("hop_budget"))
    )
    if groups is not None:
        sizes = groups.select("question_id", "group_rank").join(
            sizes, ["question_id", "group_rank"], "left"
        )
    sizes = (
        sizes.withColumn("place", F.row_number().over(per_question))
        .where(F.col("place") <= group_limit)
    )
    wanted = F.col("hops") if per_group is None else F.least(F.col("hops"), F.lit(per_group))
    earlier = per_question.rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("wanted").over(earlier), F.lit(0))
    kept = (
        sizes.withColumn("wanted", wanted)
        .withColumn(
            "kept",
            F.greatest(F.lit(0), F.least(F.col("wanted"), F.col("hop_budget") - used)),
        )
        .where(F.col("kept") > 0)
    )
    hop_place = Window.partitionBy("question_id", "group_rank").orderBy("hop")
    placed = triplets.withColumn("place", F.row_number().over(hop_place))
    # A plain bound lets map tasks drop the tail of a long group before the shuffle.
    bounds = [n for n in (per_group, hop_limit) if isinstance(n, int)]
    if bounds:
        placed = placed.where(F.col("place") <= min(bounds))
    return (
        placed.join(kept.select("question_id", "group_rank", "kept"), ["question_id", "group_rank"])
        .where(F.col("place") <= F.col("kept"))
        .drop("kept", "place")
    )


def matched_names(chunks: DataFrame) -> DataFrame:
    """(question_id, position, name): qualified names of the chunks, tests last."""

    named = chunks.where(F.coalesce("qualified_name", F.lit("")) != "")
    order = Window.partitionBy("question_id").orderBy(
        text.truthy(F.col("is_test")), "rank", "qualified_name"
    )
    return named.select(
        "question_id", F.row_number().over(order).alias("position"),
        F.col("qualified_name").alias("name"),
    )


def interleave(first: DataFrame, second: DataFrame) -> DataFrame:
    """Take names from two ranked lists in turn; each name once, blank names never."""

    both = first.withColumn("list_no", F.lit(1)).unionByName(second.withColumn("list_no", F.lit(2)))
    named = both.where(F.coalesce("name", F.lit("")) != "")
    kept = dedupe_ranked(named, "name", ["position", "list_no"])
    order = Window.partitionBy("question_id").orderBy("position", "list_no")
    return kept.select("question_id", F.row_number().over(order).alias("position"), "name")


def revision_gate(chunks: DataFrame, expected: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """(question_id, returned_revisions, conflict).

    ``expected`` has (question_id, revision_id or null); ``related`` holds the (question_id,
    revision_id) of sources and further context.  All rows must name one same revision.
    """

    seen = chunks.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce("revision_id", F.lit("")) == "").alias("unnamed"),
        F.min(F.nullif("revision_id", F.lit(""))).alias("low"),
        F.max(F.nullif("revision_id", F.lit(""))).alias("high"),
    )
    gate = expected.select("question_id", F.col("revision_id").alias("expected")).join(
        seen, "question_id", "left"
    )
    target = F.coalesce("expected", F.when(F.col("low") == F.col("high"), F.col("low")))
    bad = (
        (F.col("unnamed") > 0)
        | F.col("target").isNull()
        | (F.col("low") != F.col("target"))
        | (F.col("high") != F.col("target"))
    )
    gate = gate.withColumn("target", target).withColumn(
        "conflict", F.coalesce(F.col("rows") > 0, F.lit(False)) & F.coalesce(bad, F.lit(True))
    )
    if related is not None:
        other = (
            related.join(gate.select("question_id", "target"), "question_id")
            .where(~F.col("revision_id").eqNullSafe(F.col("target")))
            .select("question_id").distinct().withColumn("other", F.lit(True))
        )
        gate = gate.join(other, "question_id", "left").withColumn(
            "conflict",
            F.col("conflict")
            | (F.coalesce(F.col("rows") > 0, F.lit(False)) & F.coalesce("other", F.lit(False))),
        )
    return gate.select("question_id", F.col("target").alias("revision_id"), "conflict")


def kind_gate(chunks: DataFrame, kinds: list[str]) -> DataFrame:
    """(question_id, mismatch): some chunk is not of the requested kinds."""

    return chunks.groupBy("question_id").agg(
        F.bool_or(~F.coalesce(F.col("entity_kind").isin(*kinds), F.lit(False))).alias("mismatch")
    )


def grounded_groups(groups: DataFrame, triplets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Groups whose cited chunks all belong to the answer; no citation at all is fine."""

    cited = groups.select(*GROUP, F.explode("source_chunk_ids").alias("chunk_id")).unionByName(
        triplets.select(*GROUP, F.col("relation.chunk_id").alias("chunk_id")).where(
            F.coalesce("chunk_id", F.lit("")) != ""
        )
    )
    window = chunks.select("question_id", "chunk_id").where(F.col("chunk_id") != "").distinct()
    loose = cited.join(window, ["question_id", "chunk_id"], "left_anti").select(*GROUP).distinct()
    return groups.join(loose, GROUP, "left_anti")


def drop_covered(groups: DataFrame, triplets: DataFrame, flow_triplets: DataFrame) -> DataFrame:
    """Drop path groups whose relation ids all occur in one assembled path.

    Equal sets of relation ids are compared once.  A set looks only at the assembled sets that hold its rarest id, the
    one that the fewest of them hold, so an id in a third of all groups brings no pairs but for the set that has no other.
    Groups without a relation id stay.
    """

    def id_sets(df: DataFrame) -> DataFrame:
        rid = F.nullif(F.col("relation.id"), F.lit(""))
        return df.groupBy("question_id", "group_rank").agg(F.array_sort(F.collect_set(rid)).alias("rids")).where(
            F.size("rids") > 0)

    mine = id_sets(triplets.where(F.col("list") == "path"))
    held = id_sets(flow_triplets).select("question_id", F.col("rids").alias("held")).distinct()
    by_id = held.select("question_id", "held", F.explode("held").alias("rid"))
    holders = by_id.groupBy("question_id", "rid").agg(F.count(F.lit(1)).alias("n"))
    asked = mine.select("question_id", "rids").distinct()
    rarest = (
        asked.select("question_id", "rids", F.explode("rids").alias("rid"))
        .join(holders, ["question_id", "rid"], "left")
        .groupBy("question_id", "rids")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "rid")).alias("least"))
        .where(F.col("least.n") > 0)
        .select("question_id", "rids", F.col("least.rid").alias("rid"))
    )
    inside = (
        rarest.join(by_id, ["question_id", "rid"])
        .where(F.size(F.array_except("rids", "held")) == 0)
        .select("question_id", "rids").distinct()
    )
    covered = mine.join(inside, ["question_id", "rids"], "left_semi").select(
        "question_id", F.lit("path").alias("list"), "group_rank")
    return groups.join(covered, GROUP, "left_anti")


def entity_key(entity: Column) -> Column:
    return F.coalesce(
        F.nullif(entity["identifier"], F.lit("")), F.nullif(entity["entity_id"], F.lit("")),
        F.lit(""),
    )


def node_lookup(chunks: DataFrame) -> DataFrame:
    """(question_id, key, node_id): every id a chunk answers to; a later chunk wins."""

    keys = F.array_compact(
        F.array("node_id", F.nullif("logical_id", F.lit("")))
    )
    return (
        chunks.where(F.coalesce("node_id", F.lit("")) != "")
        .select("question_id", "rank", "node_id", F.explode(keys).alias("key"))
        .groupBy("question_id", "key")
        .agg(F.max_by("node_id", "rank").alias("node_id"))
    )


def resolve_entities(triplets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add ``source_node`` and ``target_node``: the node id of each end, or its own key."""

    lookup = node_lookup(chunks)
    keyed = triplets.withColumn("source_key", entity_key(F.col("source"))).withColumn(
        "target_key", entity_key(F.col("target"))
    )
    for side in ("source", "target"):
        ids = lookup.select(
            "question_id", F.col("key").alias(f"{side}_key"),
            F.col("node_id").alias(f"{side}_known"),
        )
        keyed = keyed.join(ids, ["question_id", f"{side}_key"], "left").withColumn(
            f"{side}_node", F.coalesce(f"{side}_known", f"{side}_key")
        )
    return keyed.drop("source_key", "target_key", "source_known", "target_known")


def restore_origin(triplets: DataFrame, chunks: DataFrame, owned_sources: DataFrame) -> DataFrame:
    """Relations without an origin whose chunk belongs to a verified source become ``byog``."""

    owned = (
        chunks.select("question_id", "chunk_id", "source_id")
        .join(owned_sources.select("source_id").distinct(), "source_id", "left_semi")
        .select("question_id", F.col("chunk_id").alias("owned_chunk")).distinct()
        .withColumn("owned", F.lit(True))
    )
    relation = F.col("relation")
    joined = triplets.withColumn("owned_chunk", relation["chunk_id"]).join(
        owned, ["question_id", "owned_chunk"], "left"
    )
    fix = (
        relation["origin"].isNull()
        & F.coalesce("owned", F.lit(False))
        & envelope.is_exact_envelope(relation["context"])
    )
    origin = F.when(fix, F.lit("byog")).otherwise(relation["origin"])
    return joined.withColumn("relation", relation.withField("origin", origin)).drop(
        "owned", "owned_chunk"
    )


def enrich_sources(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per source of an answer: its own fields, else those of its first chunk.

    Sources that the answer lists come first; a chunk without one gets a made row.
    """

    fields = [c for c in sources.columns if c not in ("question_id", "source_id", "position")]
    first = (
        chunks.where(F.coalesce("source_id", F.lit("")) != "")
        .groupBy("question_id", "source_id")
        .agg(
            F.min_by(F.struct(*[F.col(c) for c in fields if c in chunks.columns]), "rank").alias("c"),
            F.array_compact(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))),
                    lambda x: F.nullif(x["chunk_id"], F.lit("")),
                )
            ).alias("chunk_ids"),
            F.min("rank").alias("first_rank"),
        )
    )
    joined = sources.alias("s").join(first, ["question_id", "source_id"], "full_outer")
    merged = [
        (F.coalesce(F.col(f"s.{c}"), F.col(f"c.{c}")) if c in chunks.columns else F.col(f"s.{c}")).alias(c)
        for c in fields
    ]
    order = Window.partitionBy("question_id").orderBy(
        F.asc_nulls_last("s.position"), "first_rank", "source_id"
    )
    return joined.select(
        "question_id", "source_id", F.row_number().over(order).alias("position"), *merged,
        F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"),
    )


# --- stored relations of the answer ---------------------------------------------------------


def card_relations(cards: DataFrame) -> DataFrame:
    """Stored relations of the cards as rows, with the card that holds each as its chunk."""

    held = cards.select(
        "repository_id", "revision_id", F.col("source_id").alias("chunk_id"), "entities",
        F.posexplode("relations").alias("position", "r"),
    )
    entity = lambda handle: F.struct(
        F.col("entities")[handle]["identifier"].alias("identifier"), handle.alias("entity_id"),
        F.col("entities")[handle]["name"].alias("name"),
        F.col("entities")[handle]["type"].alias("type"),
        F.col("entities")[handle]["namespace"].alias("namespace"),
    )
    context = F.col("r.context")
    return held.select(
        "repository_id", "revision_id", "chunk_id", "position",
        F.col("r.source").alias("source_node"), F.col("r.target").alias("target_node"),
        entity(F.col("r.source")).alias("source"), entity(F.col("r.target")).alias("target"),
        F.struct(
            F.coalesce(envelope.field(context, "edge_id"), F.lit("")).alias("id"),
            F.col("r.predicate").alias("predicate"), F.col("r.predicate").alias("raw_predicate"),
            context.alias("context"), F.lit(None).cast("double").alias("confidence"),
            F.when(envelope.is_exact_envelope(context), F.lit("byog")).alias("origin"),
            F.col("chunk_id").alias("chunk_id"),
        ).alias("relation"),
    )


def read_relations(
    relations: DataFrame,
    chunks: DataFrame,
    sources: int = K.RELATION_SOURCES,
    limit: int = K.MAX_RELATIONS_READ,
) -> DataFrame:
    """Stored relations at the best sources of each answer, flagged ``inside`` its window.

    A source is read through its node on either side.  The relation table is joined with at
    most ``sources`` rows per question, so its rows stay in place while that side is small.
    """

    best = (
        chunks.where(F.coalesce("source_id", F.lit("")) != "")
        .groupBy("question_id", "source_id", "node_id", "repository_id", "revision_id")
        .agg(F.min("rank").alias("rank"))
    )
    by_rank = Window.partitionBy("question_id").orderBy("rank", "source_id")
    # Written first, so the planner knows how few rows they are and the relations stay in place.
    best = cut(best.withColumn("place", F.row_number().over(by_rank)).where(F.col("place") <= sources))
    keys = ["repository_id", "revision_id"]
    ends = relations.withColumn(
        "node_id", F.explode(F.array_distinct(F.array("source_node", "target_node")))
    )
    read = ends.join(best.select("question_id", "node_id", "place", *keys), keys + ["node_id"])
    # The order of a read: a source's own relations first, then by chunk and position.
    own = F.when(F.col("node_id") == F.col("source_node"), 0).otherwise(1)
    per_source = Window.partitionBy("question_id", "place").orderBy(own, "chunk_id", "position")
    window = chunks.select("question_id", "chunk_id").distinct().withColumn("inside", F.lit(True))
    return (
        read.withColumn("read_no", F.row_number().over(per_source))
        .where(F.col("read_no") <= limit)
        .join(window, ["question_id", "chunk_id"], "left")
        .withColumn("inside", F.coalesce("inside", F.lit(False)))
        .drop("node_id")
    )


def outside_endpoints(read: DataFrame) -> DataFrame:
    """(question_id, position, identifier) of entities that relations outside the window name."""

    ends = read.where(~F.col("inside")).select(
        "question_id", "place", "read_no",
        F.posexplode(F.array("source.identifier", "target.identifier")).alias("end_no", "identifier"),
    )
    first = (
        ends.where(F.coalesce("identifier", F.lit("")) != "")
        .groupBy("question_id", "identifier")
        .agg(F.min(F.struct("place", "read_no", "end_no")).alias("seen"))
    )
    order = Window.partitionBy("question_id").orderBy("seen")
    return first.select(
        "question_id", F.row_number().over(order).alias("position"), "identifier"
    )


def relation_groups(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations inside the window as (groups, triplets), one relation per group."""

    order = Window.partitionBy("question_id").orderBy("place", "read_no")
    inside = read.where("inside").withColumn("group_rank", F.row_number().over(order))
    inside = inside.withColumn("list", F.lit("relation"))
    named = F.nullif(F.col("relation.id"), F.lit(""))
    fallback = F.concat(
        F.lit("relations_"),
        F.substring(F.sha2(F.to_json(F.struct("source", "target", "relation")), 256), 1, 24),
    )
    groups = inside.select(
        *GROUP, F.coalesce(named, fallback).alias("group_id"),
        F.lit(None).cast("double").alias("score"), F.lit("").alias("summary"),
        F.array("chunk_id").alias("source_chunk_ids"),
        F.lit(None).cast("string").alias("origin"),
    )
    triplets = inside.select(*GROUP, F.lit(1).alias("hop"), "source", "target", "relation")
    return groups, triplets


def complete_window(
    chunks: DataFrame,
    cards: DataFrame,
    relations: DataFrame,
    rounds: int = K.COMPLETION_ROUNDS,
    budget: int = K.COMPLETION_NAMES,
    tests: str = "last",
) -> DataFrame:
    """Add the cards that join the matched cards, found by their names, in a few rounds.

    Names come in turn from entities that relations outside the window name and from the
    matched chunks.  Cards of another revision are refused.
    """

    from repograph.operators import retrieval

    pool = cards if tests == "only" else cards.where(~F.col("is_test"))
    chunks = cut(chunks)
    # The pool is the same in all rounds, so it is indexed once.
    index = retrieval.build_index(pool.select(F.col("source_id").alias("document_id"), "content"))
    for _ in range(rounds):
        outside = outside_endpoints(read_relations(relations, chunks))
        known = cards.select("logical_id", "qualified_name").distinct()
        found = outside.join(known, F.col("identifier") == F.col("logical_id")).select(
            "question_id", "position", F.col("qualified_name").alias("name")
        )
        names = interleave(found, matched_names(chunks)).where(F.col("position") <= budget)
        wanted = names.groupBy("question_id").agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("position", "name"))), lambda n: n["name"]
                ), " ",
            ).alias("question"),
            F.count(F.lit(1)).alias("n"),
        )
        wanted = cut(wanted)
        extra = retrieval.search_index(index, wanted.select("question_id", "question"), budget)
        extra = extra.join(wanted.select("question_id", "n"), "question_id").where(
            F.col("rank") <= F.col("n")
        ).drop("n")
        revision = chunks.select(
            "question_id", F.col("repository_id").alias("repo"), F.col("revision_id").alias("rev")
        ).distinct()
        extra = (
            retrieval._chunks(pool, extra)
            .withColumn("chunk_id", F.col("source_id"))
            .join(revision, "question_id")
            .where((F.col("repository_id") == F.col("repo")) & (F.col("revision_id") == F.col("rev")))
            .select(*chunks.columns)
            .join(chunks.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
        )
        extra = cut(extra)
        if extra.isEmpty():
            break
        chunks = cut(retrieval.merge_ranked(chunks, extra.select(*chunks.columns), "chunk_id"))
    return chunks


# --- the whole answer -----------------------------------------------------------------------


def answer(
    chunks: DataFrame,
    groups: DataFrame,
    triplets: DataFrame,
    questions: DataFrame,
    max_context_chars: int = 100_000,
    max_paths: int = 3,
    max_relations: int = 30,
    max_hops_per_path: int | None = None,
    kinds: list[str] | None = None,
    sources: DataFrame | None = None,
    owned_sources: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Gate, ground, order and budget the answers of a batch of questions.

    ``questions`` has (question_id, revision_id or null).  Returns ``status``, ``chunks``,
    ``groups``, ``triplets``, ``funnel``.  The steps store what they read of the chunks; contents join the returned
    ``chunks`` when these are read, and chunks without ``content`` come back as they are.
    """

    gate = revision_gate(chunks, questions, sources)
    status = gate.withColumn(
        "status", F.when(F.col("conflict"), "degraded").otherwise("ready")
    ).withColumn("outcome", F.when(F.col("conflict"), "revision_conflict"))
    if kinds:
        wrong = kind_gate(chunks, kinds)
        status = (
            status.join(wrong, "question_id", "left")
            .withColumn("outcome", F.coalesce(
                "outcome", F.when(F.col("mismatch"), F.lit("entity_kind_mismatch"))))
            .withColumn("status", F.when(F.col("outcome").isNull(), "ready").otherwise("degraded"))
            .drop("mismatch")
        )
    ready = status.where(F.col("status") == "ready").select("question_id")
    chunks = chunks.join(ready, "question_id", "left_semi")
    groups = groups.join(ready, "question_id", "left_semi")
    triplets = triplets.join(ready, "question_id", "left_semi")
    if owned_sources is not None:
        triplets = restore_origin(triplets, chunks, owned_sources)

    # Each step is read several times below and holds one bounded answer per question.
    whole = chunks
    chunks = cut(chunks.select(*[c for c in chunks.columns if c in CHUNK_STEPS]))
    kept = cut(grounded_groups(groups, triplets, chunks))
    kept_triplets = cut(resolve_entities(triplets.join(kept, GROUP, "left_semi"), chunks))
    flows, flow_triplets = paths.assemble_flows(
        chunks, kept_triplets, max_paths=max(1, max_paths),
        max_hops=max_hops_per_path or max(1, max_relations),
    )
    flows = cut(flows)
    left_paths = cut(drop_covered(kept, kept_triplets, flow_triplets))

    # Assembled flows stand in front of the returned paths.
    number = F.coalesce(F.col("flows"), F.lit(0))
    flow_counts = flows.groupBy("question_id").agg(F.max("group_rank").alias("flows"))

    def shifted(df: DataFrame) -> DataFrame:
        return (
            df.join(flow_counts, "question_id", "left")
            .withColumn(
                "group_rank",
                F.when(F.col("list") == "path", F.col("group_rank") + number).otherwise(
                    F.col("group_rank")
                ),
            )
            .drop("flows")
        )

    all_groups = flows.unionByName(shifted(left_paths))
    columns = [*GROUP, "hop", "source", "target", "relation", "source_node", "target_node"]
    all_triplets = flow_triplets.select(*columns, "source_role", "target_role").unionByName(
        shifted(kept_triplets.join(left_paths, GROUP, "left_semi")).select(
            *columns, F.lit(None).cast("string").alias("source_role"),
            F.lit(None).cast("string").alias("target_role"),
        )
    )
    all_triplets = cut(all_triplets)
    path_hops = budget_hops(
        all_triplets.where(F.col("list") == "path"), max_paths, max_relations, max_hops_per_path,
        all_groups.where(F.col("list") == "path"),
    )
    path_hops = cut(path_hops)
    used = path_hops.groupBy("question_id").agg(F.count(F.lit(1)).alias("used"))
    relation_rows = all_triplets.where(F.col("list") == "relation").join(used, "question_id", "left")
    relation_hops = budget_hops(
        relation_rows, 1_000_000_000,
        F.greatest(F.lit(0), F.lit(max_relations) - F.coalesce("used", F.lit(0))),
        max_hops_per_path,
    ).drop("used")
    hops = cut(path_hops.unionByName(relation_hops))
    out_groups = all_groups.join(hops, GROUP, "left_semi")
    return {
        "status": status,
        "chunks": budget_context(whole, max_context_chars) if "content" in whole.columns else whole,
        "groups": out_groups,
        "triplets": hops,
        "funnel": funnel(status, chunks, groups, kept, flows, out_groups, hops),
    }


def funnel(status, chunks, groups, grounded, flows, out_groups, hops) -> DataFrame:
    """Counts per question at each stage, and the stage that emptied the graph."""

    def counted(df: DataFrame, **tests) -> DataFrame:
        return df.groupBy("question_id").agg(
            *[F.count_if(test).alias(name) for name, test in tests.items()]
        )

    path, relation = F.col("list") == "path", F.col("list") == "relation"
    joined = status.select("question_id", "outcome")
    for part in (
        counted(chunks, raw_chunks=F.lit(True)),
        counted(groups, raw_paths=path, raw_relations=relation),
        counted(grounded, grounded_paths=path, grounded_relations=relation),
        counted(flows, assembled_paths=F.lit(True)),
        counted(out_groups, kept_paths=path, kept_relations=relation),
        counted(hops, hops=F.lit(True)),
    ):
        joined = joined.join(part, "question_id", "left")
    joined = joined.fillna(0)
    none = lambda a, b: (F.col(a) == 0) & (F.col(b) == 0)
    outcome = F.coalesce(
        "outcome",
        F.when(F.col("hops") > 0, "ok")
        .when(F.col("raw_chunks") == 0, "no_chunks")
        .when(none("raw_paths", "raw_relations"), "no_graph_context")
        .when(none("kept_paths", "kept_relations"), "all_groups_ungrounded")
        .otherwise("no_hops"),
    )
    return joined.select(
        "question_id", outcome.alias("outcome"), "raw_chunks", "raw_paths", "raw_relations",
        (F.col("raw_paths") - F.col("grounded_paths")).alias("dropped_paths"),
        (F.col("raw_relations") - F.col("grounded_relations")).alias("dropped_relations"),
        "assembled_paths", "kept_paths", "kept_relations", "hops",
    )


def shape_counts(triplets: DataFrame) -> DataFrame:
    """Triplets whose two ends are entities of a repository, and the others."""

    own = F.coalesce(F.col("source.identifier").startswith("repo:"), F.lit(False)) & F.coalesce(
        F.col("target.identifier").startswith("repo:"), F.lit(False)
    )
    return triplets.groupBy("question_id").agg(
        F.count_if(own).alias("own"), F.count_if(~own).alias("other")
    )


def focus(
    triplets: DataFrame,
    chunks: DataFrame,
    symbols: DataFrame,
    relations: list[str] | None = None,
    direction: str = "both",
) -> DataFrame:
    """Flag ``hidden`` on hops that miss the wanted predicates or direction at a symbol.

    ``symbols`` has (question_id, symbol).  Without a matching chunk the direction is open.
    """

    if direction not in ("in", "out", "both"):
        raise ValueError("direction must be in, out or both")
    wanted = [r.strip().upper() for r in relations or [] if r.strip()]
    keep = F.lit(True)
    if wanted:
        keep = F.upper(F.coalesce("relation.predicate", F.lit(""))).isin(*wanted)
    if direction == "both":
        return triplets.withColumn("hidden", ~keep)
    name = text.last_name(F.trim(F.col("symbol")))
    at = (
        chunks.join(symbols.where(F.trim("symbol") != ""), "question_id")
        .where((F.coalesce("node_id", F.lit("")) != "")
               & (text.last_name(F.coalesce("qualified_name", F.lit(""))) == name))
        .select("question_id", "node_id").distinct()
    )
    side = "source_node" if direction == "out" else "target_node"
    any_at = at.select("question_id").distinct().withColumn("has_focus", F.lit(True))
    hit = at.withColumn("hit", F.lit(True)).withColumnRenamed("node_id", side)
    return (
        triplets.join(any_at, "question_id", "left").join(hit, ["question_id", side], "left")
        .withColumn(
            "hidden",
            ~(keep & (F.col("has_focus").isNull() | F.coalesce("hit", F.lit(False)))),
        )
        .drop("has_focus", "hit")
    )


def answer_events(hops: DataFrame) -> DataFrame:
    """(question_id, relationship_ids, entity_ids) named by an answer, each at most 100."""

    order = ["list", "group_rank", "hop", "side"]
    named = (
        hops.where(F.col("list") == "path")
        .select(
            "question_id", "list", "group_rank", "hop",
            F.inline(
                F.array(
                    F.struct(F.lit(0).alias("side"), F.lit("r").alias("t"), F.col("relation.id").alias("name")),
                    F.struct(F.lit(1).alias("side"), F.lit("e").alias("t"), F.col("source_node").alias("name")),
                    F.struct(F.lit(2).alias("side"), F.lit("e").alias("t"), F.col("target_node").alias("name")),
                )
            ),
        )
        .where(F.coalesce("name", F.lit("")) != "")
        .groupBy("question_id", "t", "name")
        .agg(F.min(F.struct(*order)).alias("seen"))
    )
    place = Window.partitionBy("question_id", "t").orderBy("seen")
    short = named.withColumn("place", F.row_number().over(place)).where(
        F.col("place") <= K.MAX_EVENT_REFERENCES
    )

    def listed(kind: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("t") == kind, F.struct("place", "name"))))
        return F.transform(rows, lambda r: r["name"])

    return short.groupBy("question_id").agg(
        listed("r").alias("relationship_ids"), listed("e").alias("entity_ids")
    )
