"""Scoring of retrieval runs against gold facts.

Observations: ``runs`` (run_id, question_id, condition, mode, status, context_chars,
context_tokens, latency_ms) and the long tables ``nodes`` (.., node_id), ``relations`` (..,
edge_id, source_id, predicate, target_id, quality, evidence_key) and ``evidence`` (..,
evidence_id, path, 4 span parts, excerpt_hash), all keyed by (run_id, question_id, condition).
Gold: ``nodes``, ``relations`` and ``evidence`` keyed by question_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.functions import envelope, ids, text

RUN = ["run_id", "question_id", "condition"]
RELATION = ["edge_id", "source_id", "predicate", "target_id", "quality"]
EVIDENCE = ["evidence_id", "path", "start_line", "start_column", "end_line", "end_column", "excerpt_hash"]
CONDITIONS = ["A", "B", "C"]


def _counts(df: DataFrame, keys: list[str], **tests: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(test).alias(name) for name, test in tests.items()])


def score(gold: dict[str, DataFrame], observed: dict[str, DataFrame]) -> DataFrame:
    """One row of metrics per run, question and condition; every count is a join."""

    runs = observed["runs"]
    quality = F.col("quality")
    exact, inferred = quality == "exact", quality == "inferred"
    hit = F.coalesce("hit", F.lit(False))

    gold_nodes = gold["nodes"].select("question_id", "node_id").distinct()
    gold_relations = gold["relations"].select("question_id", *RELATION).dropDuplicates(["question_id", "edge_id"])
    gold_evidence = gold["evidence"].select("question_id", *EVIDENCE).dropDuplicates(["question_id", "evidence_id"])
    required = [
        _counts(gold_nodes, ["question_id"], required_nodes=F.lit(True)),
        _counts(gold_relations, ["question_id"], required_exact_relations=exact,
                required_inferred_relations=inferred),
        _counts(gold_evidence, ["question_id"], required_evidence=F.lit(True)),
    ]
    nodes = observed["nodes"].select(*RUN, "node_id").distinct().join(
        gold_nodes.withColumn("hit", F.lit(True)), ["question_id", "node_id"], "left")
    relations = observed["relations"].select(*RUN, *RELATION, "evidence_key").distinct().join(
        gold_relations.withColumn("hit", F.lit(True)), ["question_id", *RELATION], "left")
    hits = relations.where(hit).select(*RUN, *RELATION).distinct()
    same = reduce(
        lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"g.{c}")) for c in EVIDENCE[1:]])
    found = (
        observed["evidence"].select(*RUN, *EVIDENCE).alias("o")
        .join(gold_evidence.alias("g"), ["question_id", "evidence_id"])
        .where(same).select(*RUN, "evidence_id").distinct()
    )
    returned = [
        _counts(nodes, RUN, returned_nodes=F.lit(True), required_node_hits=hit),
        _counts(relations, RUN, returned_exact_relations=exact, returned_inferred_relations=inferred,
                returned_other_relations=~quality.isin("exact", "inferred"),
                supported_returned_exact=exact & hit, supported_returned_inferred=inferred & hit,
                unsupported_relations=~hit),
        _counts(hits, RUN, exact_relation_hits=exact, inferred_relation_hits=inferred),
        _counts(found, RUN, evidence_hits=F.lit(True)),
    ]
    joined = runs.select(*RUN, "context_chars", "context_tokens", "latency_ms")
    for part in required:
        joined = joined.join(part, "question_id", "left")
    for part in returned:
        joined = joined.join(part, RUN, "left")
    names = [c for part in required + returned for c in part.columns if c not in RUN]
    filled = joined.fillna(0, names)
    return filled.withColumn("useful_returned_nodes", F.col("required_node_hits"))


def audit_metrics(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(run, question, condition, side): stored metric rows that do not recompute."""

    columns = sorted(c for c in fresh.columns)
    left, right = stored.select(*columns), fresh.select(*columns)
    wrong = left.exceptAll(right).withColumn("side", F.lit("stored"))
    lacking = right.exceptAll(left).withColumn("side", F.lit("recomputed"))
    return wrong.unionByName(lacking).select(*RUN, "side")


def completeness(records: DataFrame, questions: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(reason) rows that forbid comparing the conditions; none when the run is complete.

    ``records`` has RUN, mode, status, gold_digest, corpus_digest, target and ``plan``, the
    request as JSON without its graph flag, with ``graph_context`` beside it.  ``expected``
    names the gold_digest, corpus_digest and target.
    """

    totals = records.agg(
        F.countDistinct("run_id").alias("runs"), F.countDistinct("mode").alias("modes"),
        F.coalesce(F.bool_or((F.col("mode") == "live") & ~ids.concrete_run_id(F.col("run_id"))), F.lit(False)).alias("vague"),
        *[F.coalesce(F.bool_or(~F.col(name).eqNullSafe(F.lit(value))), F.lit(False)).alias(name)
          for name, value in expected.items()],
    )
    said = {
        "run_id:not_one": F.col("runs") != 1,
        "mode:not_one": F.col("modes") != 1,
        "run_id:not_concrete": F.col("vague"),
        "gold_digest:other": F.col("gold_digest"),
        "corpus_digest:other": F.col("corpus_digest"),
        "target:other": F.col("target"),
    }
    run_wide = totals.select(F.explode(F.array_compact(F.array(*[
        F.when(test, F.lit(reason)) for reason, test in said.items()]))).alias("reason"))
    wanted = questions.select("question_id").distinct()
    slots = wanted.select("question_id", F.explode(F.array(*[F.lit(c) for c in CONDITIONS])).alias("condition"))
    counted = records.groupBy("question_id", "condition").agg(F.count(F.lit(1)).alias("n"))
    per_slot = slots.join(counted, ["question_id", "condition"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))).where(F.col("n") != 1).select(
        F.format_string("%s:%s count=%d", "question_id", "condition", "n").alias("reason"))
    of = lambda c, value: F.max(F.when(F.col("condition") == c, value))
    by_question = records.groupBy("question_id").agg(
        F.bool_or(F.col("status") != "ready").alias("not_ready"),
        of("B", F.lit(1)).alias("b"), of("C", F.lit(1)).alias("c"),
        of("B", F.col("plan")).alias("b_plan"), of("C", F.col("plan")).alias("c_plan"),
        F.bool_and(F.when(F.col("condition") == "B", ~F.col("graph_context"))).alias("b_flag"),
        F.bool_and(F.when(F.col("condition") == "C", F.col("graph_context"))).alias("c_flag"),
    )
    known = by_question.join(wanted, "question_id", "left_semi")
    unready = known.where("not_ready").select(
        F.concat("question_id", F.lit(":not_ready")).alias("reason"))
    paired = (F.col("b_plan") == F.col("c_plan")) & F.col("b_flag") & F.col("c_flag")
    unpaired = known.where(
        F.col("b").isNotNull() & F.col("c").isNotNull() & ~F.coalesce(paired, F.lit(False))
    ).select(F.concat("question_id", F.lit(":plans_not_paired")).alias("reason"))
    extra = by_question.join(wanted, "question_id", "left_anti").select(
        F.concat(F.lit("unexpected:"), "question_id").alias("reason"))
    return reduce(DataFrame.unionByName, [run_wide, per_slot, unready, unpaired, extra])


def claims(reasons: DataFrame, records: DataFrame, questions: DataFrame) -> DataFrame:
    """One row: complete, live_results, comparative_claims_allowed."""

    missing = reasons.agg(F.count(F.lit(1)).alias("missing"))
    asked = questions.agg(F.count(F.lit(1)).alias("asked"))
    live = records.agg(F.coalesce(F.bool_and(F.col("mode") == "live"), F.lit(False)).alias("live_results"))
    # Three one-row tables.
    row = missing.crossJoin(asked).crossJoin(live)
    complete = (F.col("missing") == 0) & (F.col("asked") > 0)
    return row.select(
        complete.alias("complete"), "live_results",
        (complete & F.col("live_results")).alias("comparative_claims_allowed"))


def outcome_problems(outcomes: DataFrame, metrics: DataFrame, expected: DataFrame, binding: dict[str, str]) -> DataFrame:
    """(question_id, condition, problem): outcomes that do not bind their retrieval records.

    ``expected`` has (question_id, condition); ``binding`` names run_id, agent, model and
    digest of the manifest.
    """

    key = ["question_id", "condition"]
    calls, tools = F.col("query_calls"), F.col("tool_calls")
    paths = F.concat("correct_files", "unnecessary_files")
    bad_path = lambda p: (
        (p == "") | (F.length(p) > 1024) | p.rlike(r"^[/\\]") | F.split_part(p, F.lit("/"), F.lit(1)).contains(":")
        | F.array_contains(F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/"), "..")
    )
    rules = {
        "task_completed and outcome disagree": F.col("task_completed") != (F.col("outcome") == "completed"),
        "run id is not concrete": ~ids.concrete_run_id(F.col("run_id")),
        "condition A cannot query": (F.col("condition") == "A") & (calls != 0),
        "conditions B and C need a query": (F.col("condition") != "A") & (calls < 1),
        "more queries than tool calls": calls > tools,
        "file paths must be repository-relative": F.exists(paths, bad_path),
        "file lists must be disjoint": F.size(F.array_distinct(paths)) != F.size(paths),
    }
    for name, value in binding.items():
        rules[f"{name} does not bind the manifest"] = ~F.col(name).eqNullSafe(F.lit(value))
    broken = F.explode(F.array_compact(F.array(*[
        F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()])))
    own = outcomes.select(*key, broken.alias("problem"))
    counted = outcomes.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.max("context_characters").alias("said"))
    cover = expected.withColumn("wanted", F.lit(True)).join(counted, key, "full_outer").join(
        metrics.select(*key, "context_chars"), key, "left")
    problem = (
        F.when(F.col("wanted").isNull(), "unexpected outcome")
        .when(F.col("n").isNull(), "missing outcome")
        .when(F.col("n") > 1, "repeated outcome")
        .when(~F.col("said").eqNullSafe(F.col("context_chars")), "context size differs")
    )
    return own.unionByName(
        cover.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(*key, "problem"))


def observations(
    status: DataFrame, chunks: DataFrame, groups: DataFrame, hops: DataFrame,
    run_id: str, condition: str, mode: str = "offline",
) -> dict[str, DataFrame]:
    """Observation tables of a batch of answers.

    A relation without a proven origin counts as unknown; two texts under one id make the
    answer an error of size 0.
    """

    run = [F.lit(run_id).alias("run_id"), "question_id", F.lit(condition).alias("condition")]
    relation, context = F.col("relation"), F.col("relation.context")
    parsed = envelope.parse(context)
    ours = F.coalesce(parsed["schema"] == F.lit(envelope.K.EVIDENCE_SCHEMA), F.lit(False))
    edge_id = F.coalesce(F.when(ours, F.nullif(parsed["edge_id"], F.lit(""))), F.nullif(relation["id"], F.lit("")))
    predicate = F.coalesce(F.nullif(relation["predicate"], F.lit("")), relation["raw_predicate"])
    item = parsed["evidence"]
    named = F.coalesce(item["evidence_id"], item["id"])
    sound = ours & named.isNotNull() & (F.coalesce(item["path"], F.lit("")) != "") & text.valid_evidence_span(item)
    own = relation["origin"].eqNullSafe(F.lit("byog"))
    claimed = F.when(ours, parsed["quality"])
    quality = F.when(
        own & F.coalesce(sound, F.lit(False)) & claimed.isin("exact", "inferred", "semantic"), claimed
    ).when(own & ~claimed.eqNullSafe(F.lit("exact")) & item.isNull() & claimed.isin("inferred", "semantic"), claimed
    ).otherwise("unknown")
    rows = hops.where(F.col("list") == "path").select(
        *run, edge_id.alias("edge_id"), F.col("source_node").alias("source_id"),
        predicate.alias("predicate"), F.col("target_node").alias("target_id"), quality.alias("quality"),
        F.when(own & F.coalesce(sound, F.lit(False)), F.struct(
            named.alias("evidence_id"), item["path"].alias("path"), item["start_line"].alias("start_line"),
            item["start_column"].alias("start_column"), item["end_line"].alias("end_line"),
            item["end_column"].alias("end_column"), item["excerpt_hash"].alias("excerpt_hash"))).alias("item"),
    )
    relations = rows.where(
        F.col("edge_id").isNotNull() & (F.col("source_id") != "") & (F.col("target_id") != "")
        & (F.coalesce("predicate", F.lit("")) != "")
    ).withColumn("evidence_key", F.coalesce(F.to_json("item"), F.lit("")))
    evidence = relations.where(F.col("item").isNotNull()).select(*RUN, "item.*").dropDuplicates([*RUN, "evidence_id"])
    nodes = chunks.where(F.coalesce("node_id", F.lit("")) != "").select(*run, "node_id").unionByName(
        rows.select(*RUN, F.explode(F.array("source_id", "target_id")).alias("node_id"))
    ).where(F.col("node_id") != "").distinct()
    said = chunks.select(
        "question_id", F.struct(F.lit(0).alias("a"), F.col("rank").alias("b"), F.lit(0).alias("c")).alias("seen"),
        F.coalesce("chunk_id", "source_id", "node_id").alias("name"), F.col("content").alias("said"),
    ).unionByName(groups.select(
        "question_id", F.struct(F.lit(1).alias("a"), F.col("group_rank").alias("b"), F.lit(0).alias("c")),
        F.col("group_id"), F.col("summary"),
    ).toDF("question_id", "seen", "name", "said")).unionByName(hops.select(
        "question_id", F.struct(F.lit(1).alias("a"), F.col("group_rank").alias("b"), F.col("hop").cast("int").alias("c")),
        relation["id"], F.concat_ws(" ", predicate, F.nullif(context, F.lit(""))),
    ).toDF("question_id", "seen", "name", "said"))
    said = said.where(F.coalesce("said", F.lit("")) != "").withColumn(
        "name", F.coalesce(F.nullif("name", F.lit("")), F.sha2("said", 256)))
    distinct = said.groupBy("question_id", "name").agg(
        F.min_by("said", "seen").alias("said"), F.min("said").alias("low"), F.max("said").alias("high"))
    size = distinct.groupBy("question_id").agg(
        F.bool_or(F.col("low") != F.col("high")).alias("two_texts"),
        (F.sum(F.length("said")) + F.count(F.lit(1)) - 1).alias("chars"),
        F.sum(text.token_count(F.col("said"))).alias("words"))
    conflict = F.coalesce("two_texts", F.lit(False))
    runs = status.join(size, "question_id", "left").select(
        *run, F.lit(mode).alias("mode"), F.when(conflict, "error").otherwise(F.col("status")).alias("status"),
        F.when(conflict, 0).otherwise(F.coalesce("chars", F.lit(0))).cast("bigint").alias("context_chars"),
        F.when(conflict, 0).otherwise(F.coalesce("words", F.lit(0))).cast("bigint").alias("context_tokens"),
        F.lit(0.0).alias("latency_ms"))
    return {"runs": runs, "nodes": nodes, "relations": relations.drop("item"), "evidence": evidence}


def baseline_observations(ranked: DataFrame, corpus: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """Condition A: ranked documents with their evidence and no relations.

    ``corpus`` has (document_id, node_id, content, evidence).
    """

    run = [F.lit(run_id).alias("run_id"), "question_id", F.lit("A").alias("condition")]
    rows = ranked.join(corpus, "document_id")
    evidence = rows.select(*run, F.inline("evidence")).dropDuplicates([*RUN, "evidence_id"])
    runs = rows.groupBy("question_id").agg(
        (F.sum(F.length("content")) + F.count(F.lit(1)) - 1).alias("context_chars"),
        F.sum(text.token_count(F.col("content"))).alias("context_tokens"),
    ).select(*run, F.lit("offline").alias("mode"), F.lit("ready").alias("status"),
             "context_chars", "context_tokens", F.lit(0.0).alias("latency_ms"))
    nothing = F.lit("")
    relations = rows.select(*run, *[nothing.alias(c) for c in RELATION], nothing.alias("evidence_key")).limit(0)
    return {"runs": runs, "nodes": rows.select(*run, "node_id"), "relations": relations, "evidence": evidence}


def union_observations(*parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The observation tables of several conditions as one set."""

    return {name: reduce(DataFrame.unionByName, [p[name] for p in parts]) for name in parts[0]}


def grounded(chunks: DataFrame, groups: DataFrame, hops: DataFrame, target: DataFrame, graph_context: bool) -> DataFrame:
    """(question_id, grounded): everything an answer shows is proven by its own chunks.

    ``target`` has (question_id, repository_id, revision_id).
    """

    alien = chunks.join(
        target.select("question_id", F.col("repository_id").alias("repo"), F.col("revision_id").alias("rev")),
        "question_id",
    ).groupBy("question_id").agg(F.bool_or(
        ~F.col("repository_id").eqNullSafe(F.col("repo")) | ~F.col("revision_id").eqNullSafe(F.col("rev"))
    ).alias("alien"))
    window = chunks.select("question_id", "chunk_id").where(F.coalesce("chunk_id", F.lit("")) != "").distinct()
    nodes = chunks.select("question_id", "node_id").where(F.coalesce("node_id", F.lit("")) != "").distinct()
    uncited = groups.where(F.size(F.filter("source_chunk_ids", lambda c: c != "")) == 0).select("question_id")
    cited = groups.select("question_id", F.explode("source_chunk_ids").alias("chunk_id")).where(
        F.col("chunk_id") != "").unionByName(
        hops.select("question_id", F.coalesce("relation.chunk_id", F.lit("")).alias("chunk_id")))
    loose = cited.join(window, ["question_id", "chunk_id"], "left_anti").select("question_id")
    ends = hops.select("question_id", F.explode(F.array("source_node", "target_node")).alias("node_id"))
    stray = ends.join(nodes, ["question_id", "node_id"], "left_anti").select("question_id")
    unowned = hops.where(~F.col("relation.origin").eqNullSafe(F.lit("byog"))).select("question_id")
    bad = reduce(DataFrame.unionByName, [uncited, loose, stray, unowned]).distinct().withColumn("bad", F.lit(True))
    has = lambda df, name: df.select("question_id").distinct().withColumn(name, F.lit(True))
    row = target.select("question_id").join(alien, "question_id", "left").join(
        bad, "question_id", "left").join(has(groups, "some_group"), "question_id", "left").join(
        has(hops, "some_hop"), "question_id", "left")
    some = F.col("some_group").isNotNull()
    shape = (some & F.col("some_hop").isNotNull()) if graph_context else ~some
    return row.select(
        "question_id",
        (F.coalesce(~F.col("alien"), F.lit(False)) & F.col("bad").isNull() & shape).alias("grounded"))


# --- gold and corpus checks ------------------------------------------------------------------


def gold_problems(gold: dict[str, DataFrame], nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(question_id, record, record_id): gold facts that the graph does not hold as stated.

    Gold nodes carry ``logical_id``, relations logical ends, evidence its edge id.
    """

    ids_of = nodes.select("logical_id", F.col("id").alias("node_id"))
    lost_nodes = gold["nodes"].join(ids_of, "logical_id", "left_anti").select(
        "question_id", F.lit("node").alias("record"), F.col("logical_id").alias("record_id"))
    ends = gold["relations"]
    for side in ("source", "target"):
        ends = ends.join(ids_of.select(F.col("logical_id").alias(f"{side}_logical_id"),
                                       F.col("node_id").alias(f"{side}_id")), f"{side}_logical_id", "left")
    facts = edges.select(F.col("id").alias("edge_id"), "source_id", "predicate", "target_id", "quality")
    lost_relations = ends.join(facts, RELATION, "left_anti").select(
        "question_id", F.lit("relation").alias("record"), F.col("edge_id").alias("record_id"))
    held = edges.select(F.col("id").alias("edge_id"), F.explode("evidence").alias("e")).select("edge_id", "e.*")
    same = reduce(lambda a, b: a & b, [F.col(f"g.{c}").eqNullSafe(F.col(f"h.{c}")) for c in EVIDENCE[1:]])
    lost_evidence = gold["evidence"].alias("g").join(
        held.withColumnRenamed("id", "evidence_id").alias("h"),
        (F.col("g.edge_id") == F.col("h.edge_id")) & (F.col("g.evidence_id") == F.col("h.evidence_id")) & same,
        "left_anti",
    ).select("question_id", F.lit("evidence").alias("record"), F.col("evidence_id").alias("record_id"))
    return reduce(DataFrame.unionByName, [lost_nodes, lost_relations, lost_evidence])


def corpus_problems(corpus: DataFrame, nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(document_id, problem): documents that are no exact, complete copy of their node.

    ``files`` has (path, text).  A document's evidence must be all outgoing evidence.
    """

    base = nodes.select(F.col("id").alias("node_id"), "path", "span").join(
        files.select("path", F.col("text").alias("source_text")), "path", "left")
    joined = corpus.join(base, "node_id", "full_outer")
    outgoing = edges.select(F.col("source_id").alias("node_id"), F.explode("evidence.id").alias("evidence_id")).distinct()
    listed = corpus.select("node_id", F.explode("evidence.evidence_id").alias("evidence_id")).distinct()
    problem = (
        F.when(F.col("document_id").isNull(), "missing document")
        .when(F.col("path").isNull(), "unknown node")
        .when(F.col("document_id") != F.col("node_id"), "document id is not its node id")
        .when(~text.excerpt(F.col("source_text"), F.col("span")).eqNullSafe(F.col("content")), "not source-derived")
    )
    own = joined.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(
        F.coalesce("document_id", "node_id").alias("document_id"), "problem")
    repeated = corpus.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(
        F.col("node_id").alias("document_id"), F.lit("repeated node").alias("problem"))
    key = ["node_id", "evidence_id"]
    wrong = listed.join(outgoing, key, "left_anti").unionByName(outgoing.join(listed, key, "left_anti"))
    incomplete = wrong.select(
        F.col("node_id").alias("document_id"), F.lit("evidence is not the outgoing set").alias("problem")).distinct()
    return reduce(DataFrame.unionByName, [own, repeated, incomplete])
