"""Incremental publishing: what changed against the manifest, and the new snapshot.

The manifest has (repository_id, source_id, card_hash, has_graph) of the published snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID = ["repository_id", "source_id"]


def publish_plan(manifest: DataFrame, hashes: DataFrame, full_recovery: bool = False) -> DataFrame:
    """(repository_id, source_id, action, stale_graph) for every card on either side.

    ``action`` is added, replaced, removed or unchanged; after an interrupted publish every
    common card is replaced.  ``stale_graph``: a replaced card that lost its graph.
    """

    old = manifest.select(*ID, F.col("card_hash").alias("old_hash"), F.col("has_graph").alias("had"))
    new = hashes.select(*ID, F.col("card_hash").alias("new_hash"), F.col("has_graph").alias("has"))
    same = F.lit(False) if full_recovery else F.col("old_hash") == F.col("new_hash")
    action = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "removed")
        .when(same, "unchanged")
        .otherwise("replaced")
    )
    stale = (F.col("action") == "replaced") & F.col("had") & ~F.col("has")
    return (
        old.join(new, ID, "full_outer").withColumn("action", action)
        .select(*ID, "action", F.coalesce(stale, F.lit(False)).alias("stale_graph"), "new_hash", "has")
    )


def apply_plan(published: DataFrame, cards: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next snapshot and its manifest: untouched rows, plus added and replaced cards."""

    changed = plan.where(F.col("action").isin("added", "replaced"))
    gone = plan.where(F.col("action") != "unchanged").select(*ID)
    kept = published.join(gone, ID, "left_anti")
    snapshot = kept.unionByName(cards.join(changed.select(*ID), ID, "left_semi").select(*published.columns))
    manifest = plan.where(F.col("action") != "removed").select(
        *ID, F.col("new_hash").alias("card_hash"), F.col("has").alias("has_graph")
    )
    return snapshot, manifest


def write_snapshot(snapshot: DataFrame, manifest: DataFrame, root: str, name: str) -> None:
    """Write the snapshot first and the manifest last; readers go by the manifest."""

    snapshot.write.mode("errorifexists").partitionBy("repository_id").parquet(f"{root}/cards/{name}")
    manifest.withColumn("snapshot", F.lit(name)).write.mode("errorifexists").parquet(
        f"{root}/manifest/{name}"
    )


def snapshot_mismatches(manifest: DataFrame, hashes: DataFrame) -> DataFrame:
    """Cards that the manifest does not confirm, with the reason; none when it verifies."""

    old = manifest.select(*ID, F.col("card_hash").alias("old_hash"))
    new = hashes.select(*ID, F.col("card_hash").alias("new_hash"))
    reason = (
        F.when(F.col("old_hash").isNull(), "not_published")
        .when(F.col("new_hash").isNull(), "missing_card")
        .when(F.col("old_hash") != F.col("new_hash"), "changed")
    )
    return old.join(new, ID, "full_outer").withColumn("reason", reason).where(
        F.col("reason").isNotNull()
    ).select(*ID, "reason")


def verifies_snapshot(manifest: DataFrame, hashes: DataFrame, revisions: DataFrame) -> DataFrame:
    """(repository_id, verified): hashes match and the ready revision is the one asked for.

    ``revisions`` has (repository_id, ready_revision, revision_id).
    """

    bad = snapshot_mismatches(manifest, hashes).select("repository_id").distinct()
    return revisions.join(bad.withColumn("bad", F.lit(True)), "repository_id", "left").select(
        "repository_id",
        (F.col("bad").isNull() & F.col("ready_revision").eqNullSafe(F.col("revision_id"))).alias(
            "verified"
        ),
    )


def reconcile(expected: DataFrame, acks: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(batch_id, source_id, problem) where expected and confirmed ids disagree.

    ``expected`` has (batch_id, source_id); ``acks`` (batch_id, source_id, status, error).
    ``counts`` (batch_id, confirmed_count) is the total that the store reported.
    """

    good = (F.coalesce("error", F.lit("")) == "") & ~F.coalesce(
        F.lower("status").isin("errored", "failed", "rejected"), F.lit(False)
    )
    confirmed = (
        acks.where(F.trim("source_id") != "")
        .groupBy("batch_id", "source_id").agg(F.bool_or(good).alias("good"), F.max("error").alias("error"))
    )
    problem = (
        F.when(F.col("wanted").isNull() & F.col("good"), "unexpected")
        .when(F.col("wanted").isNotNull() & F.col("good").isNull(), "not confirmed")
        .when(F.col("wanted").isNotNull() & ~F.col("good"), F.coalesce("error", F.lit("rejected")))
    )
    rows = (
        expected.withColumn("wanted", F.lit(True))
        .join(confirmed, ["batch_id", "source_id"], "full_outer")
        .withColumn("problem", problem)
    )
    found = rows.where(F.col("problem").isNotNull()).select("batch_id", "source_id", "problem")
    if counts is None:
        return found
    totals = rows.groupBy("batch_id").agg(
        F.count_if(F.col("good") & F.col("wanted")).alias("confirmed"),
        F.count("wanted").alias("expected"),
    )
    wrong = counts.join(totals, "batch_id").where(
        (F.col("confirmed_count") != F.col("expected"))
        & (F.col("confirmed_count") != F.col("confirmed"))
    )
    return found.unionByName(
        wrong.select("batch_id", F.lit("__aggregate__").alias("source_id"),
                     F.lit("reported count disagrees with confirmed items").alias("problem"))
    )
