"""Queries on the document corpus and the transition graph: ranking, answers, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from repograph.operators import answer, paths, retrieval
from repograph.plans import fixtures
from repograph.plans.catalog import register

TOKENS = """regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*')"""


def words_cte(name: str, table: str, key: str, where: str = "true") -> str:
    """(key, token, amount, total) of a text column, with the parts of joined words."""

    return f"""{name}_raw AS (SELECT {key} AS id, lower(unnest({TOKENS.format(text='text')})) AS w
      FROM {table} WHERE {where}),
    {name}_all AS (SELECT id, w AS token FROM {name}_raw UNION ALL
      SELECT id, p FROM (SELECT id, w, unnest(string_split(w, '_')) AS p FROM {name}_raw
        WHERE contains(w, '_')) WHERE p <> '' AND p <> w),
    {name} AS MATERIALIZED (SELECT id, token, count(*) AS amount,
      sum(count(*)) OVER (PARTITION BY id) AS total FROM {name}_all GROUP BY id, token)"""


def tfidf_cte(where: str = "true", suffix: str = "", corpus: str = "documents") -> str:
    """scored{suffix}(question_id, document_id, score) over the documents of a filter."""

    d, q, s = f"dw{suffix}", f"qw{suffix}", suffix
    return f"""{words_cte(d, corpus, 'doc_id', where)}, {words_cte(q, 'benchmark', 'item_id')},
    idf{s} AS MATERIALIZED (SELECT token, ln(((SELECT count(*) FROM {corpus} WHERE {where}) + 1)
      / (count(*) + 1)::DOUBLE) + 1 AS idf FROM {d} GROUP BY token),
    dv{s} AS (SELECT id, token, amount / total::DOUBLE * idf AS weight FROM {d}
      JOIN idf{s} USING (token)),
    qv{s} AS (SELECT id, token, amount / total::DOUBLE * idf AS weight FROM {q}
      JOIN idf{s} USING (token)),
    dn{s} AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM dv{s} GROUP BY id),
    qn{s} AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM qv{s} GROUP BY id),
    dots{s} AS (SELECT qv{s}.id AS q, dv{s}.id AS d, sum(qv{s}.weight * dv{s}.weight) AS dot
      FROM qv{s} JOIN dv{s} USING (token) GROUP BY 1, 2),
    scored{s} AS (SELECT 'q' || q AS question_id, 'd' || d AS document_id,
      dot / (qn{s}.norm * dn{s}.norm) AS score FROM dots{s} JOIN qn{s} ON q = qn{s}.id
      JOIN dn{s} ON d = dn{s}.id)"""


def top_cte(name: str, scored: str, k: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id
      ORDER BY round(score, 9) DESC, document_id) AS rank FROM {scored}) WHERE rank <= {k})"""


def _docs(cards):
    return cards.select(F.col("source_id").alias("document_id"), "content")


@register(
    "tfidf_topk",
    f"WITH {tfidf_cte()}, {top_cte('best', 'scored', 10)} "
    "SELECT question_id, rank, document_id, round(score, 6) AS score FROM best",
)
def tfidf_topk(spark, sf_dir):
    cards = fixtures.document_cards(spark, sf_dir)
    found = retrieval.tfidf_search(_docs(cards), fixtures.benchmark_questions(spark, sf_dir), 10)
    return found.select(
        "question_id", F.col("rank").cast("bigint").alias("rank"), "document_id",
        F.round("score", 6).alias("score"),
    )


CARDS = """cards AS (SELECT documents.*, coalesce(toxic, 0) = 1 AS is_test FROM documents
  LEFT JOIN labels USING (doc_id))"""
LAST = f"""WITH {CARDS}, {tfidf_cte('NOT is_test', '_code', 'cards')},
    {tfidf_cte('is_test', '_test', 'cards')},
    {top_cte('first', 'scored_code', 8)}, {top_cte('tail', 'scored_test', 2)},
    merged AS (SELECT question_id, document_id, score, row_number() OVER (
      PARTITION BY question_id ORDER BY l, rank) AS rank FROM (
        SELECT 1 AS l, * FROM first UNION ALL SELECT 2, * FROM tail))"""


@register(
    "retrieve_tests_last",
    f"{LAST} SELECT question_id, rank, document_id AS source_id, round(score, 6) AS score "
    "FROM merged",
)
def retrieve_tests_last(spark, sf_dir):
    return fixtures.retrieved(spark, sf_dir).select(
        "question_id", F.col("rank").cast("bigint").alias("rank"), "source_id",
        F.round("score", 6).alias("score"),
    )


@register(
    "answer_budget",
    f"""{LAST}, sized AS (SELECT question_id, rank, length(text) AS n,
        coalesce(sum(length(text)) OVER (PARTITION BY question_id ORDER BY rank
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
      FROM merged JOIN documents ON document_id = 'd' || doc_id)
    SELECT question_id, rank, least(n, greatest(0, 5000 - used))::BIGINT AS kept_chars,
      n > greatest(0, 5000 - used) AS content_truncated FROM sized""",
)
def answer_budget(spark, sf_dir):
    kept = answer.budget_context(fixtures.retrieved(spark, sf_dir), 5000)
    return kept.select(
        "question_id", F.col("rank").cast("bigint").alias("rank"),
        F.length("content").cast("bigint").alias("kept_chars"), "content_truncated",
    )


@register(
    "matched_names",
    f"""{LAST} SELECT question_id, document_id AS name, row_number() OVER (
      PARTITION BY question_id ORDER BY is_test, rank) AS position
    FROM merged JOIN cards ON document_id = 'd' || doc_id""",
)
def matched_names(spark, sf_dir):
    names = answer.matched_names(fixtures.retrieved(spark, sf_dir))
    return names.withColumn("position", F.col("position").cast("bigint"))


# Names by rank in turn with names by document id, each once.
@register(
    "interleave_names",
    f"""{LAST}, pooled AS (SELECT question_id, document_id AS name, 1 AS l, rank AS position FROM merged
      UNION ALL SELECT question_id, document_id, 2, row_number() OVER (
        PARTITION BY question_id ORDER BY document_id) FROM merged),
    earliest AS (SELECT question_id, name, min(position * 2 + l) AS seen_at FROM pooled GROUP BY 1, 2)
    SELECT question_id, name, row_number() OVER (PARTITION BY question_id ORDER BY seen_at) AS position
    FROM earliest""",
)
def interleave_names(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = fixtures.retrieved(spark, sf_dir)
    by_rank = rows.select(
        "question_id", F.col("rank").alias("position"), F.col("source_id").alias("name")
    )
    order = Window.partitionBy("question_id").orderBy("source_id")
    by_name = rows.select(
        "question_id", F.row_number().over(order).alias("position"),
        F.col("source_id").alias("name"),
    )
    names = answer.interleave(by_rank, by_name)
    return names.withColumn("position", F.col("position").cast("bigint"))


@register(
    "revision_gate",
    f"""{LAST} SELECT question_id, count(DISTINCT source) > 1 AS conflict,
      CASE WHEN count(DISTINCT source) = 1 THEN min(source) END AS revision_id
    FROM merged JOIN cards ON document_id = 'd' || doc_id GROUP BY question_id""",
)
def revision_gate(spark, sf_dir):
    """Documents of several sources in one answer are a conflict of revisions."""

    chunks = fixtures.retrieved(spark, sf_dir)
    expected = chunks.select("question_id").distinct().withColumn(
        "revision_id", F.lit(None).cast("string")
    )
    return answer.revision_gate(chunks, expected)


@register(
    "kind_gate",
    f"""{LAST} SELECT question_id, count(*) FILTER (lang <> 'en') > 0 AS mismatch
    FROM merged JOIN cards ON document_id = 'd' || doc_id GROUP BY question_id""",
)
def kind_gate(spark, sf_dir):
    return answer.kind_gate(fixtures.retrieved(spark, sf_dir), ["en"])


@register(
    "entry_point_list",
    f"""WITH {CARDS} SELECT 'd' || doc_id AS node_id, source AS revision_id,
      row_number() OVER (PARTITION BY source
        ORDER BY source || '/' || lang || '/' || doc_id, 'd' || doc_id) AS position
    FROM cards WHERE doc_id % 3 = 0
    QUALIFY position <= 20""",
)
def entry_point_list(spark, sf_dir):
    cards = fixtures.document_cards(spark, sf_dir).withColumn(
        "is_entry_point", F.col("doc_no") % 3 == 0
    )
    return retrieval.list_entry_points(cards).select(
        "node_id", "revision_id", F.col("position").cast("bigint").alias("position")
    )


# --- relation groups: every event of a user is a relation of the group of that user ----------

GROUPS = """WITH triplets AS (
    SELECT 'day-' || strftime(ts, '%Y-%m-%d') AS question_id, user_id AS group_rank,
      row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), user_id ORDER BY event_id) AS n,
      event_id, user_id, json_extract_string(props, '$.k') AS k FROM events)"""


@register(
    "hop_budget",
    f"""{GROUPS}, sizes AS (SELECT question_id, group_rank, count(*) AS hops,
      row_number() OVER (PARTITION BY question_id ORDER BY group_rank) AS place
      FROM triplets GROUP BY 1, 2 QUALIFY place <= 40),
    kept AS (SELECT *, greatest(0, least(least(hops, 3), 60 - coalesce(sum(least(hops, 3)) OVER (
      PARTITION BY question_id ORDER BY group_rank ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0))) AS kept FROM sizes)
    SELECT question_id, group_rank, event_id FROM triplets
    JOIN kept USING (question_id, group_rank) WHERE n <= kept""",
)
def hop_budget(spark, sf_dir):
    _, triplets = fixtures.event_groups(spark, sf_dir)
    kept = answer.budget_hops(triplets, 40, 60, 3)
    return kept.select("question_id", "group_rank", "event_id")


WINDOW = "SELECT DISTINCT question_id, k FROM triplets WHERE user_id % 3 <> 0"


@register(
    "grounded_groups",
    f"""{GROUPS}, seen AS ({WINDOW}),
    loose AS (SELECT DISTINCT question_id, group_rank FROM triplets t WHERE NOT EXISTS (
      SELECT 1 FROM seen s WHERE s.question_id = t.question_id AND s.k = t.k))
    SELECT DISTINCT question_id, group_rank FROM triplets
    WHERE (question_id, group_rank) NOT IN (SELECT (question_id, group_rank) FROM loose)""",
)
def grounded_groups(spark, sf_dir):
    """Groups of a day's users whose items all occur with users outside a third of them."""

    groups, triplets = fixtures.event_groups(spark, sf_dir)
    window = triplets.where(F.col("group_rank") % 3 != 0).select(
        "question_id", F.col("relation.chunk_id").alias("chunk_id")
    )
    return answer.grounded_groups(groups, triplets, window).select("question_id", "group_rank")


@register(
    "drop_covered",
    f"""{GROUPS}, mine AS (SELECT DISTINCT question_id, group_rank, k FROM triplets),
    flows AS (SELECT DISTINCT question_id, group_rank AS flow_rank, k FROM mine
      WHERE group_rank % 5 = 0),
    sizes AS (SELECT question_id, group_rank, count(*) AS n FROM mine GROUP BY 1, 2),
    covered AS (SELECT question_id, group_rank, flow_rank FROM mine
      JOIN flows USING (question_id, k) JOIN sizes USING (question_id, group_rank)
      GROUP BY 1, 2, 3, n HAVING count(*) = n)
    SELECT DISTINCT question_id, group_rank FROM mine
    WHERE (question_id, group_rank) NOT IN (SELECT (question_id, group_rank) FROM covered)""",
)
def drop_covered(spark, sf_dir):
    """Groups whose items are no part of the group of one of every fifth user of that day."""

    groups, triplets = fixtures.event_groups(spark, sf_dir)
    flows = triplets.where(F.col("group_rank") % 5 == 0)
    return answer.drop_covered(groups, triplets, flows).select("question_id", "group_rank")


@register(
    "shape_counts",
    f"""{GROUPS} SELECT question_id, count(*) FILTER (user_id % 2 = 0) AS own,
      count(*) FILTER (user_id % 2 <> 0) AS other FROM triplets GROUP BY 1""",
)
def shape_counts(spark, sf_dir):
    _, triplets = fixtures.event_groups(spark, sf_dir)
    return answer.shape_counts(triplets)


# --- paths ----------------------------------------------------------------------------------

# Level by level over distinct nodes, so the recursion holds each node once per level.
PATHS = """WITH RECURSIVE steps AS (
    SELECT DISTINCT 'day-' || strftime(ts, '%Y-%m-%d') AS day, '' || user_id AS a,
      json_extract_string(props, '$.k') AS b
    FROM events WHERE event_type IN ('purchase', 'signup')
      AND '' || user_id <> json_extract_string(props, '$.k')),
  starts AS (SELECT day, min(a) AS anchor FROM steps GROUP BY day),
  walk(day, anchor, node, hops) AS (
    SELECT day, anchor, anchor, 0 FROM starts
    UNION SELECT w.day, w.anchor, s.b, w.hops + 1 FROM walk w JOIN steps s
      ON w.day = s.day AND w.node = s.a WHERE w.hops < 8)"""


@register(
    "shortest_paths",
    f"""{PATHS} SELECT day, anchor, node AS target, min(hops) AS hops FROM walk
    WHERE node <> anchor GROUP BY 1, 2, 3""",
)
def shortest_paths(spark, sf_dir):
    """From the first user of each day to everything reachable in eight steps."""

    edges = fixtures.transitions(spark, sf_dir).select(
        F.col("repository_id").alias("day"), F.col("source_id").alias("source"),
        F.col("target_id").alias("target"), "predicate", F.col("id").alias("relation_id"),
        F.col("event_id").alias("order_no"),
    ).where(F.col("predicate").isin("CALLS", "INSTANTIATES"))
    anchors = edges.groupBy("day").agg(F.min("source").alias("anchor"))
    found = paths.reach_paths(edges, anchors, ["day"], 8)
    return found.select(
        "day", "anchor", F.col("node").alias("target"), F.size("path").alias("hops")
    )
