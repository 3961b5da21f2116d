"""Retrieval responses, gold facts, corpora, observations and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph import schemas

META = "STRUCT<repository_id: STRING, revision_id: STRING, entity_kind: STRING, language: STRING, relation_quality: STRING, is_generated: BOOLEAN, is_test: STRING, is_entry_point: STRING>"
MORE = "STRUCT<node_id: STRING, logical_id: STRING, qualified_name: STRING, path: STRING, start_line: INT, start_column: INT, end_line: INT, end_column: INT, signature: STRING, content_hash: STRING, parser: STRING, parser_version: STRING>"
LINK = "STRUCT<relationship_id: STRING, relation_id: STRING, canonical_predicate: STRING, raw_predicate: STRING, context: STRING, confidence: DOUBLE, origin: STRING, chunk_id: STRING>"
GROUP = (
    "STRUCT<group_id: STRING, relevancy_score: DOUBLE, combined_context: STRING, source_chunk_ids: ARRAY<STRING>, "
    f"origin: STRING, triplets: ARRAY<STRUCT<source: {schemas.ENTITY}, target: {schemas.ENTITY}, relation: {LINK}>>>"
)
RESPONSE = (
    "question_id STRING, data STRUCT<chunks: ARRAY<STRUCT<chunk_uuid: STRING, id: STRING, chunk_content: STRING, "
    f"source_title: STRING, source_type: STRING, relevancy_score: DOUBLE, metadata: {META}, additional_metadata: {MORE}>>, "
    f"sources: ARRAY<STRUCT<id: STRING, title: STRING, type: STRING, metadata: {META}, additional_metadata: {MORE}>>, "
    f"graph_context: STRUCT<query_paths: ARRAY<{GROUP}>, chunk_relations: ARRAY<{GROUP}>>>"
)


def _card(prefix: str) -> list[Column]:
    meta, more = f"{prefix}.metadata", f"{prefix}.additional_metadata"
    place = [F.col(f"{more}.{n}") for n in ("start_line", "start_column", "end_line", "end_column")]
    whole = place[0].isNotNull() & place[1].isNotNull() & place[2].isNotNull() & place[3].isNotNull()
    return [
        *[F.col(f"{meta}.{n}").alias(n) for n in ("repository_id", "revision_id", "entity_kind", "language", "relation_quality")],
        F.coalesce(F.col(f"{meta}.is_generated"), F.lit(False)).alias("is_generated"),
        F.col(f"{meta}.is_test").alias("is_test"), F.col(f"{meta}.is_entry_point").alias("is_entry_point"),
        *[F.col(f"{more}.{n}").alias(n) for n in ("node_id", "logical_id", "qualified_name", "path", "signature", "content_hash", "parser", "parser_version")],
        F.when(whole, F.struct(*[p.alias(n) for p, n in zip(place, ("start_line", "start_column", "end_line", "end_column"))])).alias("span"),
    ]


def read_responses(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Retrieval responses as ``chunks``, ``sources``, ``groups`` and ``triplets``.

    One JSON object per file; a response without a question id is named by its file.
    """

    raw = spark.read.option("multiLine", True).schema(RESPONSE).json(path).withColumn(
        "question_id", F.coalesce("question_id", F.element_at(F.split(F.input_file_name(), "/"), -1)))
    chunks = raw.select("question_id", F.posexplode("data.chunks").alias("n", "c")).select(
        "question_id", (F.col("n") + 1).alias("rank"), F.coalesce("c.chunk_uuid", F.lit("")).alias("chunk_id"),
        F.coalesce("c.id", F.lit("")).alias("source_id"), F.coalesce("c.chunk_content", F.lit("")).alias("content"),
        F.col("c.relevancy_score").alias("score"), F.col("c.source_title").alias("title"), F.col("c.source_type"), *_card("c"))
    sources = raw.select("question_id", F.posexplode("data.sources").alias("n", "s")).select(
        "question_id", (F.col("n") + 1).alias("position"), F.coalesce("s.id", F.lit("")).alias("source_id"),
        F.col("s.title").alias("title"), F.col("s.type").alias("source_type"), *_card("s"))
    listed = [
        raw.select("question_id", F.lit(name).alias("list"), F.posexplode(f"data.graph_context.{field}").alias("n", "g"))
        for name, field in (("path", "query_paths"), ("relation", "chunk_relations"))
    ]
    both = listed[0].unionByName(listed[1]).withColumn("group_rank", F.col("n") + 1)
    groups = both.select(
        "question_id", "list", "group_rank", F.col("g.group_id").alias("group_id"), F.col("g.relevancy_score").alias("score"),
        F.coalesce("g.combined_context", F.lit("")).alias("summary"),
        F.coalesce("g.source_chunk_ids", F.array().cast("array<string>")).alias("source_chunk_ids"), F.col("g.origin").alias("origin"))
    link = F.col("t.relation")
    triplets = both.select("question_id", "list", "group_rank", F.posexplode("g.triplets").alias("h", "t")).select(
        "question_id", "list", "group_rank", (F.col("h") + 1).alias("hop"), F.col("t.source").alias("source"), F.col("t.target").alias("target"),
        F.struct(
            F.coalesce(link["relationship_id"], link["relation_id"]).alias("id"),
            F.coalesce(link["canonical_predicate"], link["raw_predicate"]).alias("predicate"), link["raw_predicate"].alias("raw_predicate"),
            link["context"].alias("context"), link["confidence"].alias("confidence"), link["origin"].alias("origin"),
            link["chunk_id"].alias("chunk_id")).alias("relation"))
    return {"chunks": chunks, "sources": sources, "groups": groups, "triplets": triplets}


PROOF = "STRUCT<evidence_id: STRING, path: STRING, start_line: INT, start_column: INT, end_line: INT, end_column: INT, excerpt_hash: STRING>"
GOLD = (
    "repository_id STRING, revision_id STRING, questions ARRAY<STRUCT<id: STRING, prompt: STRING, required_node_logical_ids: ARRAY<STRING>, "
    "required_relations: ARRAY<STRUCT<edge_id: STRING, source_logical_id: STRING, predicate: STRING, target_logical_id: STRING, "
    f"quality: STRING, evidence: ARRAY<{PROOF}>>>>>"
)


def read_gold(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A gold manifest as ``questions``, ``nodes``, ``relations`` and ``evidence``."""

    asked = spark.read.option("multiLine", True).schema(GOLD).json(path).select(
        "repository_id", "revision_id", F.explode("questions").alias("q"))
    key = F.col("q.id").alias("question_id")
    relations = asked.select(key, F.explode("q.required_relations").alias("r")).select("question_id", "r.*")
    return {
        "questions": asked.select("repository_id", "revision_id", key, F.col("q.prompt").alias("question")),
        "nodes": asked.select(key, F.explode("q.required_node_logical_ids").alias("logical_id")),
        "relations": relations.drop("evidence"),
        "evidence": relations.select("question_id", "edge_id", F.explode("evidence").alias("e")).select("question_id", "edge_id", "e.*"),
    }


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, node_id, content, evidence) of a JSON array of documents."""

    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(
        f"document_id STRING, node_id STRING, content STRING, evidence ARRAY<{PROOF}>").json(path)


# Columns of the metric summary, in order.
SUMMARY = [
    "question_id", "condition", "mode", "status", "node_hits", "required_nodes", "useful_returned_nodes", "returned_nodes",
    "exact_relation_hits", "required_exact_relations", "inferred_relation_hits", "required_inferred_relations",
    "evidence_hits", "required_evidence", "unsupported_relations", "returned_other_relations", "context_chars",
    "context_tokens", "latency_ms",
]


def write_observations(observed: dict[str, DataFrame], root: str) -> None:
    for name, table in observed.items():
        table.write.mode("errorifexists").json(f"{root}/{name}")


def read_observations(spark: SparkSession, root: str, like: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Observation tables with the schemas of ``like``; a bad line fails the read."""

    return {
        name: spark.read.schema(table.schema).option("mode", "FAILFAST").json(f"{root}/{name}")
        for name, table in like.items()
    }


def write_summary(metrics: DataFrame, runs: DataFrame, path: str) -> None:
    """The metric summary as CSV, ordered by question and condition."""

    named = metrics.join(runs.select("run_id", "question_id", "condition", "mode", "status"), ["run_id", "question_id", "condition"])
    rows = named.withColumn("node_hits", F.col("required_node_hits")).withColumn("latency_ms", F.format_string("%.3f", F.col("latency_ms").cast("double")))
    rows.select(*SUMMARY).orderBy("question_id", "condition").write.mode("errorifexists").option("header", True).csv(path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, side, line_no, line) of transcript files named ``<run>.<side>.jsonl``.

    A file is one run; its lines keep their order because a file is read as one row.
    """

    files = spark.read.option("wholetext", True).text(path).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    return files.select(
        F.split_part("name", F.lit("."), F.lit(1)).alias("run_id"), F.split_part("name", F.lit("."), F.lit(2)).alias("side"),
        F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def write_cards(records: DataFrame, graphs: DataFrame, root: str) -> None:
    """Published card records and the graphs of the cards that have relations."""

    keys = ["repository_id", "revision_id"]
    records.write.mode("errorifexists").partitionBy(*keys).json(f"{root}/records")
    graphs.write.mode("errorifexists").partitionBy(*keys).json(f"{root}/graphs")
