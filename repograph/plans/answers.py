"""Questions to views: rank, read the stored graph, complete, ground, order, bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.operators import answer, retrieval, views
from repograph.session import cut


def ask(
    cards: DataFrame,
    questions: DataFrame,
    max_results: int = 8,
    tests: str = "last",
    complete: bool = True,
    max_context_chars: int = 100_000,
    max_paths: int = 3,
    max_relations: int = 30,
    max_hops_per_path: int | None = None,
    **filters,
) -> dict[str, DataFrame]:
    """Answers of a batch of questions over a card table."""

    chunks = cut(retrieval.retrieve(cards, questions, max_results, tests, **filters))
    allowed = retrieval.card_filter(cards, **filters)
    relations = answer.card_relations(allowed)
    if complete:
        chunks = answer.complete_window(chunks, allowed, relations, tests=tests)
    read = cut(answer.read_relations(relations, chunks))
    groups, triplets = answer.relation_groups(read)
    expected = questions.select("question_id").withColumn("revision_id", F.lit(None).cast("string"))
    found = answer.answer(
        chunks, cut(groups), cut(triplets), expected, max_context_chars, max_paths, max_relations,
        max_hops_per_path)
    return {**found, "read": read}


def trace(cards: DataFrame, questions: DataFrame, max_hops: int = 8, max_paths: int = 3, **filters):
    """Ordered behaviour paths: more results, and budgets by path and hop."""

    if not (1 <= max_hops <= 20 and 1 <= max_paths <= 10):
        raise ValueError("max_hops must be 1..20 and max_paths 1..10")
    return ask(
        cards, questions, min(50, max(8, max_hops * max_paths)), max_paths=max_paths,
        max_relations=max_hops * max_paths, max_hops_per_path=max_hops, **filters)


def view(found: dict[str, DataFrame], mode: str = "explore", depth: str = "symbol", **budgets):
    """The product view of a batch of answers."""

    return views.product_view(found["triplets"], cut(views.grounding(found["chunks"])), mode, depth, **budgets)
