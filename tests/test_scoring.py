import pyarrow as pa
from pyspark.sql import functions as F

from repograph.operators import evaluation


def test_outcomes_must_bind(spark):
    row = "run_id string, agent string, model string, digest string, question_id string, condition string, task_completed boolean, outcome string, tool_calls int, query_calls int, context_characters long, correct_files array<string>, unnecessary_files array<string>"
    good = lambda q, c, calls=1, **k: ("run-7", "agent", "m", "d", q, c, True, "completed", 3, calls, 10, k.get("files", ["a.py"]), ["b.py"])
    rows = [good("q1", "A", 0), good("q1", "B"), good("q1", "C", files=["../x"]), good("q2", "A", 2), ("offline-7", *good("q2", "B")[1:])]
    outcomes = spark.createDataFrame(rows, row)
    expected = spark.createDataFrame([(q, c) for q in ("q1", "q2") for c in "ABC"], "question_id string, condition string")
    metrics = expected.withColumn("context_chars", F.when(F.col("condition") == "B", 11).otherwise(10).cast("long"))
    binding = {"run_id": "run-7", "agent": "agent", "model": "m", "digest": "d"}
    got = {(r.question_id, r.condition, r.problem) for r in evaluation.outcome_problems(outcomes, metrics, expected, binding).collect()}
    assert got == {
        ("q1", "B", "context size differs"), ("q1", "C", "file paths must be repository-relative"),
        ("q2", "A", "condition A cannot query"), ("q2", "B", "run id is not concrete"),
        ("q2", "B", "run_id does not bind the manifest"), ("q2", "B", "context size differs"), ("q2", "C", "missing outcome")}


def test_grounded_answers(spark):
    chunks = spark.createDataFrame(
        [(q, f"c{n}", n, "repo", "r1") for q in ("ok", "loose", "alien", "none") for n in "ab"],
        "question_id string, chunk_id string, node_id string, repository_id string, revision_id string")
    chunks = chunks.withColumn("revision_id", F.when(F.col("question_id") == "alien", "r0").otherwise("r1"))
    groups = spark.createDataFrame([("ok", ["ca"]), ("loose", ["cz"]), ("alien", ["ca"])], "question_id string, source_chunk_ids array<string>")
    hops = groups.select("question_id", F.lit("a").alias("source_node"), F.lit("b").alias("target_node"),
                         F.struct(F.lit("ca").alias("chunk_id"), F.lit("byog").alias("origin")).alias("relation"))
    target = spark.createDataFrame([(q, "repo", "r1") for q in ("ok", "loose", "alien", "none")], "question_id string, repository_id string, revision_id string")
    got = {r.question_id: r.grounded for r in evaluation.grounded(chunks, groups, hops, target, True).collect()}
    assert got == {"ok": True, "loose": False, "alien": False, "none": False}
    bare = evaluation.grounded(chunks, groups.limit(0), hops.limit(0), target, False).collect()
    assert {r.question_id: r.grounded for r in bare} == {"ok": True, "loose": True, "alien": False, "none": True}


def test_complete_run_allows_claims(spark):
    rows = [("run-7", q, c, "live", "ready", "g", "c", "t", "p", c == "C") for q in ("q1", "q2") for c in "ABC"]
    schema = "run_id string, question_id string, condition string, mode string, status string, gold_digest string, corpus_digest string, target string, plan string, graph_context boolean"
    records = spark.createDataFrame(rows, schema)
    questions = spark.createDataFrame([("q1",), ("q2",)], "question_id string")
    expected = {"gold_digest": "g", "corpus_digest": "c", "target": "t"}
    reasons = evaluation.completeness(records, questions, expected)
    assert reasons.collect() == []
    assert evaluation.claims(reasons, records, questions).first().comparative_claims_allowed
    unpaired = records.withColumn("plan", F.concat("plan", "condition"))
    assert {r.reason for r in evaluation.completeness(unpaired, questions, expected).collect()} == {
        "q1:plans_not_paired", "q2:plans_not_paired"}


def test_only_asked_words_meet_the_norms(spark):
    from repograph.operators import retrieval

    rows = [("r1", f"d{i}", f"alpha w{i} w{i} beta" if i % 2 else f"w{i} rest") for i in range(20)] + [("r2", "d1", "beta"), ("r1", "none", None)]
    docs = spark.createDataFrame(rows, "repo string, document_id string, content string")
    questions = spark.createDataFrame([("r1", "q1", "alpha w3"), ("r2", "q1", "alpha beta")], "repo string, question_id string, question string")
    for keys in ([], ["repo"]):
        one = questions if keys else questions.limit(1)
        index = retrieval.build_index(docs if keys else docs.where("repo = 'r1'"), keys)
        found = retrieval.search_index(index, one, 3)
        best = {(tuple(r[k] for k in keys), r.question_id, r["rank"], r.document_id) for r in found.collect()}
        first = ("r1",) if keys else ()
        assert {x for x in best if x[0] == first and x[1] == "q1"} == {(first, "q1", 1, "d3"), (first, "q1", 2, "d1"), (first, "q1", 3, "d11")}
    sent = next(retrieval._asked_terms(pa.array(["alpha", "w3"]))(iter(
        [b for b in index.rows.where("document_id IN ('d3', 'none', 'd2')").select("document_id", "total", "terms").toArrow().combine_chunks().to_batches()])))
    held = dict(zip(sent.column("document_id").to_pylist(), sent.column("terms").to_pylist()))
    assert sorted((t["token"], t["amount"]) for t in held["d3"]) == [(0, 1), (1, 2)] and held["none"] == held["d2"] == []
