"""Budgets, flows and views against plain loops."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from repograph.operators import answer, paths, retrieval, views
from repograph.functions import envelope
from repograph import constants as K
from tests.test_graph_algorithms import bfs

ENTITY = "struct<identifier:string,entity_id:string,name:string,type:string,namespace:string>"
RELATION = "struct<id:string,predicate:string,raw_predicate:string,context:string,confidence:double,origin:string,chunk_id:string>"
TRIPLETS = f"question_id string, list string, group_rank int, hop int, source {ENTITY}, target {ENTITY}, relation {RELATION}"
CHUNKS = (
    "question_id string, rank int, chunk_id string, source_id string, content string, revision_id string, repository_id string, "
    "entity_kind string, is_test boolean, is_entry_point boolean, node_id string, logical_id string, qualified_name string, path string, "
    "span struct<start_line:int,start_column:int,end_line:int,end_column:int>, content_hash string, parser string, parser_version string, "
    "language string, signature string, is_generated boolean"
)
GROUPS = "question_id string, list string, group_rank int, group_id string, score double, summary string, source_chunk_ids array<string>, origin string"


def ent(name):
    return (f"L{name}", None, name, "FUNCTION", "repo")


def trip(q, lst, rank, hop, a, b, predicate, rid, chunk, context=None, origin=None):
    return (q, lst, rank, hop, ent(a), ent(b), (rid, predicate, predicate, context, None, origin, chunk))


def chunk(q, rank, name, test=False, entry=False, content="text"):
    return (q, rank, f"c{name}", f"s{name}", content, "r1", "repo", "FUNCTION", test, entry, name, f"L{name}", f"m.{name}",
            "m.py", (1, 0, 2, 0), "0" * 64, "p", "1", "python", None, False)


def test_context_budget_equals_the_loop(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for q in range(30):
        limit, left = 40, 40
        for rank in range(1, rng.randint(2, 8)):
            size = rng.randint(0, 25)
            kept = min(size, left)
            want[f"q{q}", rank] = (kept, size > left)
            left = left - size if size <= left else 0
            rows.append((f"q{q}", rank, "x" * size))
    table = spark.createDataFrame(rows, "question_id string, rank int, content string").repartition(5)
    got = {(r.question_id, r["rank"]): (len(r.content), r.content_truncated) for r in answer.budget_context(table, limit).collect()}
    assert got == want


def test_hop_budget_equals_the_loop(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for q in range(30):
        used, places = 0, 0
        sizes = [rng.randint(1, 5) for _ in range(rng.randint(1, 7))]
        for rank, size in enumerate(sizes, start=1):
            rows += [(f"q{q}", rank, hop) for hop in range(1, size + 1)]
            take = min(size, 3, 9 - used) if places < 4 else 0
            places, used = places + 1, used + max(0, take)
            if take > 0:
                want[f"q{q}", rank] = take
    table = spark.createDataFrame(rows, "question_id string, group_rank int, hop int")
    got = {}
    for r in answer.budget_hops(table, 4, 9, 3).collect():
        got[r.question_id, r.group_rank] = max(got.get((r.question_id, r.group_rank), 0), r.hop)
    assert got == want


def brute_flows(chunks, edges, max_paths, max_hops, min_hops=2):
    facts = {c[10]: c for c in chunks}
    ends = sorted({n for e in edges for n in e[:2]} & set(facts))
    pool = [n for n in ends if not facts[n][8]] or ends
    order = sorted(pool, key=lambda n: (facts[n][1], n))
    starts = [n for n in order if facts[n][9]]
    if not starts:
        reached = {e[1] for e in edges if e[2] != "IMPORTS"}
        starts = [n for n in order if n not in reached] or order
    found = []
    for target in order:
        for start in starts:
            if start == target or len(found) >= max_paths:
                continue
            path = bfs([e for e in edges if e[2] != "IMPORTS"], start, max_hops).get(target)
            path = path or bfs(edges, start, max_hops).get(target)
            if not path or len(path) < min_hops:
                continue
            by_no = {e[4]: e for e in edges}
            mark = {by_no[n][:4] for n in path}
            if not any(mark <= seen for _, seen in found):
                found.append((path, mark))
    return [p for p, _ in found]


def test_flows_equal_the_loop(spark):
    rng = random.Random(4)
    all_chunks, all_rows, want = [], [], {}
    for q in range(8):
        size = rng.randint(4, 8)
        names = [f"n{i}" for i in range(size)]
        chunks = [chunk(f"q{q}", r + 1, n, test=rng.random() < 0.2, entry=q % 2 == 0 and rng.random() < 0.3) for r, n in enumerate(rng.sample(names, size - 1))]
        rows, edges = [], []
        for number in range(1, size * 2):
            a, b = rng.sample(names, 2)
            predicate = rng.choice(["CALLS", "INSTANTIATES", "IMPORTS"])
            rid = f"r{number}"
            rows.append(trip(f"q{q}", "relation", number, 1, a, b, predicate, rid, f"c{a}"))
            known = {c[10] for c in chunks}
            res = lambda n: n if n in known else f"L{n}"
            edges.append((res(a), res(b), predicate, rid, number))
        all_chunks += chunks
        all_rows += rows
        want[f"q{q}"] = [[f"r{n}" for n in p] for p in brute_flows(chunks, edges, 3, 5)]
    chunk_table = spark.createDataFrame(all_chunks, CHUNKS)
    triplets = answer.resolve_entities(spark.createDataFrame(all_rows, TRIPLETS), chunk_table)
    groups, hops = paths.assemble_flows(chunk_table, triplets, 3, 5)
    got = {}
    for r in hops.orderBy("question_id", "group_rank", "hop").collect():
        flows = got.setdefault(r.question_id, {})
        flows.setdefault(r.group_rank, []).append(r.relation.id)
        assert r.source_role == ("entry" if r.hop == 1 else "step")
    assert {q: [f[k] for k in sorted(f)] for q, f in got.items()} == {q: w for q, w in want.items() if w}
    first = groups.where("question_id = 'q0'").orderBy("group_rank").first()
    if first:
        assert first.summary.startswith("1. ") and first.group_id.startswith("flow_") and first.origin == "assembled-flow"


def proof(edge_id, path="m.py"):
    return (
        f'{{"edge_id":"{edge_id}","evidence":{{"end_column":1,"end_line":1,"excerpt_hash":"{"0" * 64}","explanation":"e","id":"x",'
        f'"path":"{path}","start_column":0,"start_line":1}},"extractor":"p","extractor_version":"1","quality":"exact",'
        f'"schema":"{K.EVIDENCE_SCHEMA}","summary":"{edge_id} said"}}')


def test_answer_and_view(spark):
    chunks = spark.createDataFrame(
        [chunk("q", 1, "c"), chunk("q", 2, "b"), chunk("q", 3, "a", entry=True), chunk("x", 1, "a"),
         (*chunk("x", 2, "b")[:5], "r2", *chunk("x", 2, "b")[6:])], CHUNKS)
    rows = [
        trip("q", "relation", 1, 1, "b", "c", "CALLS", "e2", "cb", proof("edge2")),
        trip("q", "relation", 2, 1, "a", "b", "CALLS", "e1", "ca", proof("edge1")),
        trip("q", "relation", 3, 1, "a", "z", "CALLS", "e3", "cz"),
        trip("q", "path", 1, 1, "a", "b", "CALLS", "e1", "ca", proof("edge1")),
        trip("x", "relation", 1, 1, "a", "b", "CALLS", "e1", "ca"),
    ]
    groups = spark.createDataFrame([(r[0], r[1], r[2], f"g{r[2]}", None, "", [r[6][6]], None) for r in rows], GROUPS)
    questions = spark.createDataFrame([("q", None), ("x", None)], "question_id string, revision_id string")
    owned = chunks.select("source_id").distinct()
    found = answer.answer(chunks, groups, spark.createDataFrame(rows, TRIPLETS), questions, owned_sources=owned)
    status = {r.question_id: (r.status, r.outcome) for r in found["status"].collect()}
    assert status == {"q": ("ready", None), "x": ("degraded", "revision_conflict")}
    hops = [(r.list, r.group_rank, r.hop, r.source_node, r.target_node) for r in found["triplets"].orderBy("list", "group_rank", "hop").collect()]
    assert hops == [("path", 1, 1, "a", "b"), ("path", 1, 2, "b", "c"), ("relation", 1, 1, "b", "c"), ("relation", 2, 1, "a", "b")]
    funnel = found["funnel"].where("question_id = 'q'").first()
    assert (funnel.raw_relations, funnel.dropped_relations, funnel.assembled_paths, funnel.hops, funnel.outcome) == (3, 1, 1, 4, "ok")
    events = answer.answer_events(found["triplets"]).where("question_id = 'q'").first()
    assert events.relationship_ids == ["e1", "e2"] and events.entity_ids == ["a", "b", "c"]
    cards = views.grounding(found["chunks"])
    view = views.product_view(found["triplets"], cards, max_nodes=2)
    assert [r.id for r in view["nodes"].orderBy("position").collect()] == ["a", "b"]
    edges = view["edges"].collect()
    assert [(r.id, r.quality, r.context) for r in edges] == [("edge1", "exact", "edge1 said")]
    assert view["budget"].first().truncated
    assert views.explain(view["edges"], "q", "edge1").first().explanation == "edge1 said"
    focused = answer.focus(found["triplets"], found["chunks"], spark.createDataFrame([("q", "m.b")], "question_id string, symbol string"), ["calls"], "out")
    shown = {(r.list, r.source_node) for r in focused.where("not hidden").collect()}
    assert shown == {("path", "b"), ("relation", "b")}


def test_unproven_relation_stays_unknown(spark):
    chunks = spark.createDataFrame([chunk("q", 1, "a"), chunk("q", 2, "b")], CHUNKS)
    rows = [trip("q", "relation", 1, 1, "a", "b", "CALLS", "e1", "ca", proof("edge1"), "auto"),
            trip("q", "relation", 2, 1, "a", "b", "IMPORTS", "e2", "cb", None, "byog")]
    hops = answer.resolve_entities(spark.createDataFrame(rows, TRIPLETS), chunks)
    view = views.symbol_view(hops, views.grounding(chunks))
    assert [(r.id, r.quality) for r in view["edges"].collect()] == [("e1", "unknown")]
    assert view["omitted"].first().omitted_hops == 1
    assert spark.range(1).select(envelope.is_exact_envelope(F.lit("[1]")).alias("x")).first().x is False


def test_tfidf_memory_follows_postings():
    questions, words = 20_000, 40_000
    asked = pa.table({
        "question_id": [f"q{i:05d}" for i in range(questions)] * 2, "token": [f"w{i}" for i in range(words)],
        "idf": np.ones(words), "weight": np.full(words, 0.5)})
    terms = [[{"token": f"w{i}", "amount": 1}, {"token": "other", "amount": 1}] for i in range(0, 400, 2)]
    docs = pa.RecordBatch.from_pydict({
        "document_id": [f"d{i:03d}" for i in range(200)], "total": [2] * 200, "terms": terms, "doc_norm": np.ones(200)})
    tracemalloc.start()
    try:
        found = pa.Table.from_batches(retrieval._score_documents(asked, 3)(iter([docs]))).to_pylist()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100 << 20
    assert [tuple(r.values()) for r in found] == [(f"q{2 * i:05d}", f"d{i:03d}", 0.25) for i in range(200)]


def test_tfidf_blocks_equal_the_joins(spark, monkeypatch):
    pick = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame(
        [(f"d{i:03d}", " ".join(pick.choices(words, k=pick.randint(0, 30)))) for i in range(150)], "document_id string, content string")
    questions = spark.createDataFrame(
        [(f"q{i:02d}", " ".join(pick.choices(words, k=pick.randint(1, 8)))) for i in range(25)], "question_id string, question string")
    rows = lambda df: sorted((r.question_id, r.rank, r.document_id, round(r.score, 9)) for r in df.collect())
    expected = rows(retrieval.top_ranked(retrieval.tfidf_scores(docs, questions), 4))
    assert rows(retrieval.tfidf_top(docs, questions, 4)) == expected
    for name, value in {"ASKED_ROWS": 100, "HELD_ROWS": 40, "CELLS": 50}.items():
        monkeypatch.setattr(retrieval, name, value)
    assert rows(retrieval.tfidf_top(docs, questions, 4)) == expected


def _ranked(df, keys=()):
    return sorted((*(r[k] for k in keys), r.question_id, r.rank, r.document_id, round(r.score, 9)) for r in df.collect())


def test_each_corpus_is_ranked_by_its_own_frequencies(spark):
    pick = random.Random(9)
    words = [f"w{i}" for i in range(40)] + ["snake_case", "_x__y_", "9lives", "CamelCase", "naïve", "a1_b2"]
    text = lambda n: " ".join(pick.choices(words, k=pick.randint(0, n)))
    docs = spark.createDataFrame([(c, f"d{i:03d}", text(30)) for c in ("a", "b") for i in range(80)] + [("a", "none", None), ("c", "d0", "w1")],
                                 "corpus string, document_id string, content string")
    questions = spark.createDataFrame([(c, f"q{i:02d}", text(8)) for c in ("a", "b", "d") for i in range(12)],
                                      "corpus string, question_id string, question string")
    for keys in (["corpus"], []):
        some, asked = (docs, questions) if keys else (docs.where("corpus = 'a'").drop("corpus"), questions.where("corpus = 'a'").drop("corpus"))
        expected = _ranked(retrieval.top_ranked(retrieval.tfidf_scores(some, asked, keys), 4, keys), keys)
        assert _ranked(retrieval.tfidf_top(some, asked, 4, keys), keys) == expected


def test_words_are_cut_as_by_the_rule(spark):
    from pyspark.sql import functions as F

    from repograph.functions import text

    pick = random.Random(2)
    texts = ["".join(pick.choices("aB9_ é-\n", k=pick.randint(0, 40))) for _ in range(400)] + [None, "", "9", "_", "__a__b_", "a", "9a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "document_id int, content string").repartition(2)
    found = {r.document_id: (r.total, sorted(x for t in r.terms for x in [t.token] * t.amount)) for r in retrieval.document_terms(docs, []).collect()}
    for r in docs.select("document_id", F.coalesce(text.token_bag(F.col("content")), F.array()).alias("bag")).collect():
        assert found[r.document_id] == (len(r.bag), sorted(r.bag)), texts[r.document_id]


def test_an_index_is_kept_up(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", f"alpha w{i % 7} w{i % 5} beta") for i in range(60)], "document_id string, content string")
    changed = spark.createDataFrame([("d3", "gamma delta"), ("new", "alpha gamma")], docs.schema)
    questions = spark.createDataFrame([("q1", "gamma w3"), ("q2", "alpha beta w1")], "question_id string, question string")
    removed = docs.where("document_id IN ('d5', 'd6')")
    after = docs.where("document_id NOT IN ('d3', 'd5', 'd6')").unionByName(changed)
    expected = _ranked(retrieval.tfidf_top(after, questions, 5))
    for hot in (retrieval.HOT_TOKENS, 3):
        monkeypatch.setattr(retrieval, "HOT_TOKENS", hot)
        index = retrieval.update_index(retrieval.build_index(docs), changed, removed)
        assert _ranked(retrieval.search_index(index, questions, 5)) == expected


def test_covered_groups_by_their_rarest_relation(spark):
    """Against all pairs: one relation in all groups, equal groups, blank and null ids, null questions."""

    chance = random.Random(5)
    sets = [["hot"] + [f"r{chance.randrange(12)}" for _ in range(chance.randrange(4))] for _ in range(60)]
    sets += [["hot"], [""], [None], ["", "hot"], ["r1"], []]
    flows = [["hot"] + [f"r{chance.randrange(12)}" for _ in range(chance.randrange(6))] for _ in range(20)] + [[""], ["other"]]
    rows = lambda given, question: [(question, "path", i, (r,)) for i, rids in enumerate(given) for r in rids]
    schema = "question_id string, list string, group_rank int, relation struct<id: string>"
    triplets = spark.createDataFrame(rows(sets, "q") + rows(sets[:9], None) + rows(sets[:9], "alone"), schema)
    assembled = spark.createDataFrame(rows(flows, "q") + rows(flows, None), schema)
    groups = spark.createDataFrame(
        [(q, kind, i) for q in ("q", "alone", None) for kind in ("path", "other") for i in range(len(sets))],
        "question_id string, list string, group_rank int")
    real = lambda rids: {r for r in rids if r}
    gone = {("q", "path", i) for i, rids in enumerate(sets) if real(rids) and any(real(rids) <= real(f) for f in flows)}
    kept = {tuple(r) for r in answer.drop_covered(groups, triplets, assembled).collect()}
    assert 0 < len(gone) < len(sets) and kept == {tuple(r) for r in groups.collect()} - gone


def test_steps_of_an_answer_store_no_contents(spark, monkeypatch):
    from repograph.operators import answer
    from repograph.plans import fixtures

    source, stored = "/root/testdata/sf0.001", []
    chunks = fixtures.block_chunks(spark, source).where("question_id LIKE 'en-%'")
    relations = answer.card_relations(fixtures.linked_cards(spark, source))
    groups, triplets = answer.relation_groups(answer.read_relations(relations, chunks))
    expected = chunks.select("question_id").distinct().withColumn("revision_id", F.lit("r1"))
    real = answer.cut
    monkeypatch.setattr(answer, "cut", lambda df: (stored.append(df.columns), real(df))[1])
    found = answer.answer(chunks, groups, triplets, expected)
    assert stored and not any({"content", "entities", "relations"} & set(columns) for columns in stored)
    assert found["chunks"].count() == chunks.count() > 0 and "content_truncated" in found["chunks"].columns


def test_the_pool_of_all_rounds_is_indexed_once(spark, monkeypatch):
    from repograph.plans import fixtures

    source, built = "/root/testdata/sf0.001", []
    cards = fixtures.linked_cards(spark, source).where("doc_no < 40")
    chunks = fixtures.block_chunks(spark, source).where("doc_no IN (3, 9)").withColumn("question_id", F.lit("q"))
    real = retrieval.build_index
    monkeypatch.setattr(retrieval, "build_index", lambda *a: (built.append(1), real(*a))[1])
    found = answer.complete_window(chunks, cards, answer.card_relations(cards), rounds=2)
    assert len(built) == 1 and found.count() > 2
