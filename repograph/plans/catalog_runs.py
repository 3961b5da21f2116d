"""Queries on scoring, run contrast, answer windows and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from repograph.operators import answer, contrast, evaluation, views
from repograph.plans import answers, fixtures
from repograph.plans.catalog import register
from repograph.plans.catalog_answer import LAST, tfidf_cte, top_cte
from repograph.session import cut

SCORED = """WITH rows AS (SELECT 'day-' || strftime(ts, '%d') AS question_id, event_id, event_type,
      '' || user_id AS source_id, json_extract_string(props, '$.k') AS target_id,
      CASE event_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'inferred' ELSE 'unknown' END AS quality FROM events),
    edges AS (SELECT *, source_id || '-' || target_id AS edge_id, 'p' || (event_id % 2) AS path,
      CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' ELSE 'C' END AS condition FROM rows),
    gold AS (SELECT * FROM edges WHERE event_type IN ('signup', 'error')),
    seen AS (SELECT * FROM edges WHERE event_type NOT IN ('signup', 'error')),
    gold_edges AS (SELECT question_id, edge_id, arg_min(quality, event_id) AS quality FROM gold GROUP BY 1, 2),
    gold_proof AS (SELECT question_id, target_id, arg_min(path, event_id) AS path FROM gold GROUP BY 1, 2),
    need AS (SELECT question_id, count(DISTINCT source_id) AS required_nodes FROM gold GROUP BY 1),
    need_edges AS (SELECT question_id, count(*) FILTER (quality = 'exact') AS required_exact_relations,
      count(*) FILTER (quality = 'inferred') AS required_inferred_relations FROM gold_edges GROUP BY 1),
    need_proof AS (SELECT question_id, count(*) AS required_evidence FROM gold_proof GROUP BY 1),
    runs AS (SELECT question_id, condition, count(*) AS context_chars, max(event_id) AS context_tokens,
      count(DISTINCT source_id) AS returned_nodes FROM seen GROUP BY 1, 2),
    node_hits AS (SELECT question_id, condition, count(DISTINCT source_id) AS required_node_hits FROM seen
      WHERE (question_id, source_id) IN (SELECT (question_id, source_id) FROM gold) GROUP BY 1, 2),
    relations AS (SELECT DISTINCT s.question_id, condition, s.edge_id, s.quality, g.quality IS NOT NULL AS hit
      FROM seen s LEFT JOIN gold_edges g ON s.question_id = g.question_id AND s.edge_id = g.edge_id
        AND s.quality = g.quality),
    relation_counts AS (SELECT question_id, condition,
      count(*) FILTER (quality = 'exact') AS returned_exact_relations,
      count(*) FILTER (quality = 'inferred') AS returned_inferred_relations,
      count(*) FILTER (quality = 'unknown') AS returned_other_relations,
      count(*) FILTER (quality = 'exact' AND hit) AS exact_relation_hits,
      count(*) FILTER (quality = 'inferred' AND hit) AS inferred_relation_hits,
      count(*) FILTER (NOT hit) AS unsupported_relations FROM relations GROUP BY 1, 2),
    proofs AS (SELECT s.question_id, condition, count(DISTINCT s.target_id) AS evidence_hits FROM seen s
      JOIN gold_proof g ON s.question_id = g.question_id AND s.target_id = g.target_id AND s.path = g.path
      GROUP BY 1, 2)"""


@register(
    "metrics",
    f"""{SCORED} SELECT question_id, condition, context_chars, context_tokens, 1.5::DOUBLE AS latency_ms,
      'run-1' AS run_id, required_nodes, required_exact_relations, required_inferred_relations,
      required_evidence, returned_nodes, coalesce(required_node_hits, 0) AS required_node_hits,
      coalesce(required_node_hits, 0) AS useful_returned_nodes, returned_exact_relations,
      returned_inferred_relations, returned_other_relations, exact_relation_hits, inferred_relation_hits,
      exact_relation_hits AS supported_returned_exact, inferred_relation_hits AS supported_returned_inferred,
      unsupported_relations, coalesce(evidence_hits, 0) AS evidence_hits
    FROM runs JOIN need USING (question_id) JOIN need_edges USING (question_id)
    JOIN need_proof USING (question_id) LEFT JOIN node_hits USING (question_id, condition)
    JOIN relation_counts USING (question_id, condition) LEFT JOIN proofs USING (question_id, condition)""",
)
def metrics(spark, sf_dir):
    return evaluation.score(*fixtures.scored_events(spark, sf_dir))


@register(
    "metric_audit",
    f"""{SCORED} SELECT question_id, condition, unnest(['stored', 'recomputed']) AS side FROM runs
    WHERE condition = 'B'""",
)
def metric_audit(spark, sf_dir):
    """Stored metrics of condition B claim one node too many."""

    fresh = cut(evaluation.score(*fixtures.scored_events(spark, sf_dir)))
    stored = fresh.withColumn(
        "returned_nodes", F.col("returned_nodes") + F.when(F.col("condition") == "B", 1).otherwise(0))
    return evaluation.audit_metrics(stored, fresh).drop("run_id")


@register(
    "completeness",
    """WITH records AS (SELECT 'q' || conv_id AS question_id, conv_id, ['A', 'B', 'C'][1 + turn % 3] AS condition,
        length(text) % 5 = 0 AS bad, role FROM conversations),
    wanted AS (SELECT 'q' || item_id AS question_id FROM benchmark),
    slots AS (SELECT question_id, unnest(['A', 'B', 'C']) AS condition FROM wanted),
    counts AS (SELECT s.question_id, s.condition, count(r.question_id) AS n FROM slots s
      LEFT JOIN records r USING (question_id, condition) GROUP BY 1, 2)
    SELECT 'corpus_digest:other' AS reason
      WHERE EXISTS (SELECT 1 FROM records WHERE role = 'system')
    UNION ALL SELECT question_id || ':' || condition || ' count=' || n FROM counts WHERE n <> 1
    UNION ALL SELECT DISTINCT question_id || ':not_ready' FROM records
      WHERE bad AND question_id IN (SELECT question_id FROM wanted)
    UNION ALL SELECT DISTINCT 'unexpected:' || question_id FROM records
      WHERE question_id NOT IN (SELECT question_id FROM wanted)""",
)
def completeness(spark, sf_dir):
    records = fixtures.run_records(spark, sf_dir)
    questions = fixtures.benchmark_questions(spark, sf_dir)
    return evaluation.completeness(
        records, questions, {"gold_digest": "g", "corpus_digest": "c", "target": "t"})


# --- agent runs -----------------------------------------------------------------------------

RUNS = """WITH talk AS (SELECT *, turn % 5 <> 4 AS ok FROM conversations),
    runs AS (SELECT conv_id, conv_id // 2 AS run_id, CASE WHEN conv_id % 2 = 0 THEN 'base' ELSE 'other' END AS side,
      count(*) FILTER (ok AND role <> 'system') AS tool_calls,
      count(DISTINCT CASE WHEN ok AND role = 'user' THEN length(text) END) AS files_read,
      sum(length(text))::BIGINT AS n, max(turn) AS last_turn, conv_id % 11 <> 0 AS ended,
      max(CASE WHEN ok AND role = 'system' THEN 'm' || (conv_id % 3) END) AS model
      FROM talk GROUP BY conv_id),
    traces AS (SELECT *, CASE WHEN NOT ended THEN 'running' WHEN conv_id % 7 = 0 THEN 'failed'
      ELSE 'completed' END AS status FROM runs)"""


@register(
    "run_traces",
    f"""{RUNS} SELECT run_id, side, status, model, tool_calls, files_read,
      CASE WHEN ended THEN last_turn ELSE 0 END AS turns, CASE WHEN ended THEN n END AS input_tokens,
      CASE WHEN ended THEN last_turn END AS output_tokens, CASE WHEN ended THEN n END AS duration_ms
    FROM traces""",
)
def run_traces(spark, sf_dir):
    traces = contrast.run_traces(contrast.read_lines(fixtures.run_lines(spark, sf_dir)))
    return traces.select(
        "run_id", "side", "status", "model", "tool_calls", "files_read", "turns", "input_tokens",
        "output_tokens", "duration_ms")


@register(
    "run_contrast",
    f"""{RUNS}, figures AS (SELECT run_id, side, status, unnest(['Total tokens', 'Output tokens',
        'Cache read tokens', 'Tool calls', 'Files read', 'Turns', 'Cost', 'Duration']) AS label,
      unnest([CASE WHEN ended THEN n + last_turn ELSE 0 END, CASE WHEN ended THEN last_turn ELSE 0 END, 0,
        tool_calls, files_read, CASE WHEN ended THEN last_turn ELSE 0 END, NULL,
        CASE WHEN ended THEN n END])::DOUBLE AS v FROM traces),
    wide AS (SELECT run_id, label, max(v) FILTER (side = 'base') AS base, max(v) FILTER (side = 'other') AS other,
      count(*) FILTER (status = 'completed') = 2 AS comparable FROM figures GROUP BY 1, 2)
    SELECT *, CASE WHEN label <> 'Duration' THEN other - base END AS difference,
      coalesce(other, 0) < coalesce(base, 0) AS other_lower FROM wide""",
)
def run_contrast(spark, sf_dir):
    traces = contrast.run_traces(contrast.read_lines(fixtures.run_lines(spark, sf_dir)))
    return contrast.contrast(traces, ["run_id"]).drop("metric_no")


# --- answers over linked documents ------------------------------------------------------------


def _window(spark, sf_dir):
    cards = fixtures.linked_cards(spark, sf_dir)
    chunks = fixtures.retrieved(spark, sf_dir).withColumn("revision_id", F.lit("r1"))
    return cards, chunks


READ = f"""{LAST}, nodes AS (SELECT question_id, rank, replace(document_id, 'd', '')::BIGINT AS id FROM merged),
    relations AS (SELECT doc_id AS owner, doc_id AS src, doc_id + 1 AS dst, 0 AS pos FROM documents
      UNION ALL SELECT doc_id, doc_id, doc_id - 1, 1 FROM documents),
    read AS (SELECT question_id, rank, r.*, n.id = src AS own FROM nodes n JOIN relations r
      ON n.id = src OR n.id = dst)"""


@register(
    "relations_window",
    f"""{READ} SELECT question_id, 'd' || owner AS chunk_id, 'd' || src AS source_node, 'd' || dst AS target_node,
      rank AS place, (question_id, owner) IN (SELECT (question_id, id) FROM nodes) AS inside FROM read""",
)
def relations_window(spark, sf_dir):
    cards, chunks = _window(spark, sf_dir)
    read = answer.read_relations(answer.card_relations(cards), chunks)
    return read.select("question_id", "chunk_id", "source_node", "target_node",
                       F.col("place").cast("bigint").alias("place"), "inside")


@register(
    "outside_endpoints",
    f"""{READ}, ends AS (SELECT question_id, unnest([src, dst]) AS id FROM read
      WHERE (question_id, owner) NOT IN (SELECT (question_id, id) FROM nodes))
    SELECT DISTINCT question_id, 'repo:docs:d' || id AS identifier FROM ends""",
)
def outside_endpoints(spark, sf_dir):
    cards, chunks = _window(spark, sf_dir)
    read = answer.read_relations(answer.card_relations(cards), chunks)
    return answer.outside_endpoints(read).select("question_id", "identifier")


def _answers(spark, sf_dir):
    def build():
        cards = fixtures.linked_cards(spark, sf_dir)
        return answers.ask(cards, fixtures.benchmark_questions(spark, sf_dir), complete=True)

    return fixtures.once(spark, (sf_dir, "answers"), build)


@register("answer_hops")
def answer_hops(spark, sf_dir):
    """Ranked, completed, grounded, ordered and bounded answers; tests check it by brute force."""

    return _answers(spark, sf_dir)["triplets"].select(
        "question_id", "list", "group_rank", "hop", "source_node", "target_node",
        F.col("relation.predicate").alias("predicate"))


@register("answer_funnel")
def answer_funnel(spark, sf_dir):
    return _answers(spark, sf_dir)["funnel"]


@register("answer_view")
def answer_view(spark, sf_dir):
    shown = answers.view(_answers(spark, sf_dir), max_nodes=10, max_edges=8)
    return shown["budget"].join(shown["diagnostics"], "question_id")


@register("view_rollup")
def view_rollup(spark, sf_dir):
    """Answer views rolled up to the first path segment."""

    found = views.symbol_view(
        _answers(spark, sf_dir)["triplets"], cut(views.grounding(_answers(spark, sf_dir)["chunks"])))
    rolled = views.view_rollup(found["nodes"], found["edges"], "package")
    return rolled["aggregates"].drop("position")


# --- answers on windows of neighbouring documents -----------------------------------------------


# Relations of a window, its flows over calls (up the ids) or imports (down), and the budgets.  Flows
# make only path groups superfluous, and all stored relations are relation groups.
BLOCKS = """WITH chunks AS (SELECT coalesce(lang, 'und') || '-' || (doc_id // 12) AS question_id, doc_id AS id, source,
      coalesce(toxic, 0) = 1 AS is_test, row_number() OVER (PARTITION BY coalesce(lang, 'und'), doc_id // 12
        ORDER BY length(text) DESC, doc_id) AS rank,
      doc_id - row_number() OVER (PARTITION BY coalesce(lang, 'und'), doc_id // 12 ORDER BY doc_id) AS run
      FROM documents LEFT JOIN labels USING (doc_id)),
    relations AS (SELECT question_id, id AS owner, id + 1 AS dst, 'CALLS' AS predicate, 0 AS position FROM chunks
      UNION ALL SELECT question_id, id, id - 1, 'IMPORTS', 1 FROM chunks),
    read AS (SELECT r.*, row_number() OVER (PARTITION BY r.question_id
        ORDER BY n.rank, n.id <> owner, 'd' || owner, position) AS group_rank
      FROM relations r JOIN chunks n ON r.question_id = n.question_id AND (n.id = owner OR n.id = dst)),
    pool AS (SELECT *, bool_or(root) OVER (PARTITION BY question_id) AS some_root FROM (
      SELECT *, id = min(id) OVER (PARTITION BY question_id, run) AS root,
        bool_or(NOT is_test) OVER (PARTITION BY question_id) AS some_code FROM chunks)
      WHERE NOT (some_code AND is_test)),
    candidates AS (SELECT a.question_id, a.id AS a, t.id AS t, t.rank AS t_rank, a.rank AS a_rank,
        least(a.id, t.id) AS low, greatest(a.id, t.id) AS high, sign(t.id - a.id) AS way
      FROM pool a JOIN pool t ON a.question_id = t.question_id AND a.run = t.run AND abs(t.id - a.id) >= 2
      WHERE a.root OR NOT a.some_root),
    flows AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY t_rank, a_rank) AS group_rank
      FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM candidates j WHERE j.question_id = c.question_id
        AND j.way = c.way AND j.low <= c.low AND j.high >= c.high
        AND (j.t_rank, j.a_rank) < (c.t_rank, c.a_rank)) QUALIFY group_rank <= 3),
    steps AS (SELECT question_id, group_rank, hop, a + way * (hop - 1) AS owner, a + way * hop AS dst,
        CASE way WHEN 1 THEN 'CALLS' ELSE 'IMPORTS' END AS predicate
      FROM (SELECT *, unnest(range(1, high - low + 1)) AS hop FROM flows)),
    budgets AS (SELECT question_id, group_rank, 30 - coalesce(sum(high - low) OVER (PARTITION BY question_id
      ORDER BY group_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget FROM flows),
    path_hops AS (SELECT s.* FROM steps s JOIN budgets USING (question_id, group_rank) WHERE hop <= budget),
    used AS (SELECT question_id, count(*) AS used FROM path_hops GROUP BY 1),
    hops AS (SELECT question_id, 'path' AS list, group_rank, hop, owner, dst, predicate FROM path_hops
      UNION ALL SELECT question_id, 'relation', group_rank, 1, owner, dst, predicate FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY group_rank) AS place FROM read)
        LEFT JOIN used USING (question_id) WHERE place <= 30 - coalesce(used, 0)),
    charted AS MATERIALIZED (SELECT h.*, c.source AS source_group, t.source AS target_group, t.id IS NOT NULL AS fine
      FROM hops h JOIN chunks c ON c.question_id = h.question_id AND c.id = owner
      LEFT JOIN chunks t ON t.question_id = h.question_id AND t.id = dst),
    edges AS (SELECT question_id, owner, dst, predicate, source_group, target_group
      FROM charted WHERE fine GROUP BY ALL)"""


def _block_answers(spark, sf_dir):
    """Answers of ``BLOCKS``: grounded relations, flows, covered groups and budgets of all windows at once."""

    def build():
        # No query on these windows reads the documents' texts, so none of them is moved.
        chunks = cut(fixtures.block_chunks(spark, sf_dir).drop("content", "entities", "relations"))
        relations = answer.card_relations(fixtures.linked_cards(spark, sf_dir))
        groups, triplets = answer.relation_groups(cut(answer.read_relations(relations, chunks)))
        expected = chunks.select("question_id").distinct().withColumn("revision_id", F.lit("r1"))
        return answer.answer(chunks, cut(groups), cut(triplets), expected)

    return fixtures.once(spark, (sf_dir, "block answers"), build)


def _longs(df, *names):
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


@register(
    "block_hops",
    f"""{BLOCKS} SELECT question_id, list, group_rank, hop::BIGINT AS hop, 'd' || owner AS source_node,
      CASE WHEN fine THEN 'd' ELSE 'repo:docs:d' END || dst AS target_node, predicate FROM charted""",
)
def block_hops(spark, sf_dir):
    found = _block_answers(spark, sf_dir)["triplets"].select(
        "question_id", "list", "group_rank", "hop", "source_node", "target_node",
        F.col("relation.predicate").alias("predicate"))
    return _longs(found, "group_rank", "hop")


@register(
    "block_funnel",
    f"""{BLOCKS}, kept AS (SELECT question_id, count(DISTINCT group_rank) FILTER (list = 'path') AS kept_paths,
        count(DISTINCT group_rank) FILTER (list = 'relation') AS kept_relations, count(*) AS hops FROM hops GROUP BY 1),
      made AS (SELECT question_id, count(*) AS made FROM flows GROUP BY 1),
      given AS (SELECT question_id, count(*) AS given FROM read GROUP BY 1)
    SELECT question_id, 'ok' AS outcome, count(*) AS raw_chunks, 0::BIGINT AS raw_paths, any_value(given) AS raw_relations,
      0::BIGINT AS dropped_paths, 0::BIGINT AS dropped_relations, coalesce(any_value(made), 0) AS assembled_paths,
      any_value(kept_paths) AS kept_paths, any_value(kept_relations) AS kept_relations, any_value(hops) AS hops
    FROM chunks JOIN kept USING (question_id) JOIN given USING (question_id) LEFT JOIN made USING (question_id)
    GROUP BY 1""",
)
def block_funnel(spark, sf_dir):
    return _block_answers(spark, sf_dir)["funnel"]


@register(
    "block_view",
    f"""{BLOCKS}, ends AS (SELECT question_id, id, min((list, group_rank, hop, n)) AS seen FROM (
        SELECT *, unnest([owner, dst]) AS id, unnest([0, 1]) AS n FROM charted WHERE fine) GROUP BY 1, 2),
      shown AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seen) AS place FROM ends),
      counted AS (SELECT question_id, count(*) AS n FROM shown GROUP BY 1),
      eligible AS (SELECT e.question_id, count(*) AS m FROM edges e
        JOIN shown s ON s.question_id = e.question_id AND s.id = owner AND s.place <= 6
        JOIN shown t ON t.question_id = e.question_id AND t.id = dst AND t.place <= 6 GROUP BY 1)
    SELECT question_id, least(n, 6) AS returned_nodes, least(coalesce(m, 0), 8) AS returned_edges,
      n > 6 OR coalesce(m, 0) > 8 AS truncated, (SELECT count(*) FROM charted c
        WHERE c.question_id = counted.question_id AND NOT fine) AS omitted_hops, least(n, 6) AS nodes,
      NULL::VARCHAR AS outcome FROM counted LEFT JOIN eligible USING (question_id)""",
)
def block_view(spark, sf_dir):
    shown = answers.view(_block_answers(spark, sf_dir), max_nodes=6, max_edges=8)
    found = shown["budget"].join(shown["diagnostics"], "question_id")
    return _longs(found, "returned_nodes", "returned_edges", "nodes")


@register(
    "block_rollup",
    f"""{BLOCKS}, grouped AS (SELECT question_id, 'package_' || substring(sha256(source_group), 1, 24) AS source_group,
        predicate, 'package_' || substring(sha256(target_group), 1, 24) AS target_group
      FROM edges WHERE source_group <> target_group)
    SELECT question_id, 'aggregate_' || substring(sha256(source_group || ':' || predicate || ':' || target_group), 1, 24)
      AS id, source_group, predicate, target_group, count(*) AS exact_relation_count, count(*) AS evidence_count
    FROM grouped GROUP BY ALL""",
)
def block_rollup(spark, sf_dir):
    """The symbol views of all windows rolled up to the documents' sources."""

    found = _block_answers(spark, sf_dir)
    symbols = views.symbol_view(found["triplets"], cut(views.grounding(found["chunks"])))
    rolled = views.view_rollup(symbols["nodes"], symbols["edges"], "package")["aggregates"].drop("position")
    return _longs(rolled, "evidence_count")


# --- the three conditions ---------------------------------------------------------------------


@register(
    "ablation_baseline",
    f"""WITH {tfidf_cte()}, {top_cte('best', 'scored', 10)},
    joined AS (SELECT question_id, document_id, text FROM best JOIN documents ON document_id = 'd' || doc_id)
    SELECT question_id, count(*) AS returned_nodes, (sum(length(text)) + count(*) - 1)::BIGINT AS context_chars,
      sum(len(list_filter(regexp_split_to_array(text, '[\\s]+'), lambda w: w <> '')))::BIGINT AS context_tokens
    FROM joined GROUP BY question_id""",
)
def ablation_baseline(spark, sf_dir):
    from repograph.operators import retrieval

    cards = fixtures.document_cards(spark, sf_dir)
    docs = cards.select(F.col("source_id").alias("document_id"), "content")
    ranked = retrieval.tfidf_search(docs, fixtures.benchmark_questions(spark, sf_dir), 10)
    evidence = "array<struct<evidence_id:string,path:string,start_line:int,start_column:int,end_line:int,end_column:int,excerpt_hash:string>>"
    corpus = docs.select("document_id", F.col("document_id").alias("node_id"), "content",
                         F.array().cast(evidence).alias("evidence"))
    seen = evaluation.baseline_observations(ranked, corpus, "run-1")
    nodes = seen["nodes"].groupBy("question_id").agg(F.count(F.lit(1)).alias("returned_nodes"))
    return seen["runs"].join(nodes, "question_id").select(
        "question_id", "returned_nodes", "context_chars", "context_tokens")


@register("ablation_graph")
def ablation_graph(spark, sf_dir):
    """Conditions B and C over the same answers, without and with their graph."""

    found = _answers(spark, sf_dir)
    none = found["triplets"].limit(0)
    plain = evaluation.observations(
        found["status"], found["chunks"], found["groups"].limit(0), none, "run-1", "B")
    graph = evaluation.observations(
        found["status"], found["chunks"], found["groups"], found["triplets"], "run-1", "C")
    both = evaluation.union_observations(plain, graph)
    exact = both["relations"].groupBy("question_id", "condition").agg(
        F.count_if(F.col("quality") == "exact").alias("exact_relations"))
    return both["runs"].join(exact, ["question_id", "condition"], "left").select(
        "question_id", "condition", "status", "context_chars",
        F.coalesce("exact_relations", F.lit(0)).alias("exact_relations"))
