"""Comparison of two revisions of each repository.

``before`` and ``after`` tables hold one revision per repository; rows meet on
``repository_id`` and their stable id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.functions import ids, text
from repograph.operators import scc, sieve
from repograph.session import cut

REPO = ["repository_id"]
# Fixed value: the default rename threshold.
RENAME_THRESHOLD = 0.80

NODE_FIELDS = {
    # Changed-field names in their sorted order.
    "attributes": [
        "body_fingerprint", "docstring", "is_test", "is_entry_point", "entry_reasons",
        "attributes_json",
    ],
    "content_hash": ["content_hash"],
    "parser": ["parser", "parser_version"],
    "path": ["path"],
    "signature": ["signature"],
    "span": ["span"],
}


def load_pair(table: DataFrame, before: str, after: str) -> tuple[DataFrame, DataFrame]:
    """Two pruned revisions of a graph table; a revision without rows is an error."""

    if before == after:
        raise ValueError("before and after must be different revisions")
    sides = []
    for revision in (before, after):
        side = table.where(F.col("revision_id") == revision)
        if side.isEmpty():
            raise ValueError(f"no rows for revision {revision}")
        sides.append(side)
    return sides[0], sides[1]


def _mark(said: Column) -> Column:
    """96 bits of a text's hash, as in an id; null for null."""

    return F.substring(F.unhex(F.sha2(said, 256)), 1, 12)


def _marks() -> dict[str, Column]:
    """A mark for each group of fields: equal fields have equal marks, nulls included."""

    # A missing field is left out of the JSON text, so its name tells it from an empty one.
    said = lambda columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})
    return {name: _mark(said(columns)) for name, columns in NODE_FIELDS.items()}


def _changed_keys(before: DataFrame, after: DataFrame, *compared: str | Column) -> sieve.Sieve:
    """A sieve of the ids whose rows are not alike in both revisions.

    Two numbers a row are moved: a hash of its id, and 63 bits of a hash of its id and what is compared, with a bit for its side.
    """

    odd = F.lit(False)
    for name in (*REPO, "id"):
        odd = odd | F.col(name).isNull()

    def side(rows: DataFrame, bit: int) -> DataFrame:
        # A row without an id has no partner, whatever it says.
        said = F.to_json(F.struct("id", F.struct(*compared).alias("said"), F.when(odd, bit).alias("side")), {"ignoreNullFields": "true"})
        mark = F.conv(F.substring(F.sha2(said, 256), 1, 16), 16, -10).cast("long")
        return rows.select(sieve.key_hash(*REPO, "id").alias("h"), mark.bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(bit)).alias("mark"))

    plain = F.col("mark").bitwiseAND(F.lit(-2))
    sides = lambda merged: merged("mark").bitwiseAND(F.lit(1))
    # Dealt before they are counted, as hardly two rows of a task have one key.
    dealt = side(before, 0).unionByName(side(after, 1)).repartition("h")
    return sieve.Sieve(cut(
        dealt.groupBy("h").agg(F.min(plain).alias("low"), F.max(plain).alias("high"), sides(F.bit_and).alias("all"),
                               sides(F.bit_or).alias("some"))
        .where((F.col("low") != F.col("high")) | (F.col("all") == F.col("some"))).select("h")))


def _sides(
    before: DataFrame, after: DataFrame, prefix: str, keys: sieve.Sieve, compared: dict[str, Column],
    kept: list[Column] | None = None,
) -> DataFrame:
    """Rows of both revisions by id, with what is compared of each side in columns of its own; ids are packed.

    Rows whose ids are not among the changed ``keys`` stay where they are.  The records ``before`` and ``after`` hold the
    columns ``kept``, or all.  They are not needed to tell a change, so a reader who takes ids only moves no record.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        return keys.passed(rows, *REPO, "id").select(
            *REPO, ids.packed(F.col("id"), prefix).alias("id"), F.struct(*(kept or rows.columns)).alias(name),
            F.lit(True).alias(f"in_{name}"), *[value.alias(f"{name} {of}") for of, value in compared.items()])

    return side(before, "before").join(side(after, "after"), REPO + ["id"], "full_outer")


def _changed(differs: Column, other: str) -> Column:
    return (
        F.when(F.col("in_before").isNull(), "added")
        .when(F.col("in_after").isNull(), "removed")
        .when(differs, other)
    )


def _changed_nodes(before: DataFrame, after: DataFrame) -> sieve.Sieve:
    return _changed_keys(before, after, *[column for columns in NODE_FIELDS.values() for column in columns])


def _changed_edges(before: DataFrame, after: DataFrame) -> sieve.Sieve:
    return _changed_keys(before, after, F.col("evidence.id").alias("proof"))


def _node_pairs(before: DataFrame, after: DataFrame, keys: sieve.Sieve, kept: list[Column] | None = None) -> DataFrame:
    """The rows of :func:`node_changes` with packed ids."""

    fields = F.when(
        F.col("in_before") & F.col("in_after"),
        F.array_compact(F.array(*[
            F.when(F.col(f"`before {name}`") != F.col(f"`after {name}`"), F.lit(name)) for name in NODE_FIELDS])),
    ).otherwise(F.array().cast("array<string>"))
    return (
        _sides(before, after, "node", keys, _marks(), kept)
        .withColumn("changed_fields", fields)
        .withColumn("change", _changed(F.size("changed_fields") > 0, "modified"))
        .where(F.col("change").isNotNull())
        .select(*REPO, "id", "before", "after", "changed_fields", "change")
    )


def _opened_nodes(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("id", ids.unpacked(F.col("id"), "node"))


def node_changes(
    before: DataFrame, after: DataFrame, kept: list[Column] | None = None, keys: sieve.Sieve | None = None
) -> DataFrame:
    """(repository_id, id, change, changed_fields, before, after) for every changed node.

    ``keys`` are those of the changed nodes, if they were found before.
    """

    return _opened_nodes(_node_pairs(before, after, keys or _changed_nodes(before, after), kept))


def _edge_pairs(before: DataFrame, after: DataFrame, keys: sieve.Sieve, kept: list[Column] | None = None) -> DataFrame:
    """The rows of :func:`edge_changes` with packed ids, also of evidence."""

    moved = F.col("`before proof`") != F.col("`after proof`")
    proof = F.transform("evidence.id", lambda e: ids.packed(e, "evidence"))
    return (
        _sides(before, after, "edge", keys, {"proof": proof}, kept)
        .withColumn("change", _changed(moved, "evidence_moved"))
        .where(F.col("change").isNotNull())
        .select(*REPO, "id", "before", "after", "change", F.col("`before proof`").alias("before_evidence_ids"),
                F.col("`after proof`").alias("after_evidence_ids"))
    )


def _opened_edges(pairs: DataFrame) -> DataFrame:
    told = lambda name: F.transform(name, lambda e: ids.unpacked(e, "evidence"))
    return pairs.withColumns({
        "id": ids.unpacked(F.col("id"), "edge"),
        **{name: told(name) for name in ("before_evidence_ids", "after_evidence_ids")}})


def edge_changes(
    before: DataFrame, after: DataFrame, kept: list[Column] | None = None, keys: sieve.Sieve | None = None
) -> DataFrame:
    """(repository_id, id, change, before, after): added, removed and evidence_moved edges.

    ``before_evidence_ids`` and ``after_evidence_ids`` are what was compared.  ``keys`` are those of the changed edges, if
    they were found before.
    """

    return _opened_edges(_edge_pairs(before, after, keys or _changed_edges(before, after), kept))


def _packed_ends(with_proofs: bool) -> list[Column]:
    """What is stored of a changed edge: its ends, and the first evidence if asked for, with packed ids."""

    end = lambda name: ids.packed(F.col(name), "node").alias(name)
    ends = [end("source_id"), F.col("predicate"), end("target_id"), F.col("quality")]
    if not with_proofs:
        return ends
    first = F.get("evidence", F.lit(0))
    packed = first.withField("id", ids.packed(first["id"], "evidence")).withField(
        "excerpt_hash", text.packed_hash(first["excerpt_hash"]))
    return [*ends, packed.alias("proof")]


def _opened_ends(pairs: DataFrame) -> DataFrame:
    """Stored edges as they were before they were packed."""

    def opened(name: str) -> Column:
        record = F.col(name)
        fields = pairs.schema[name].dataType.names
        columns = {field: record[field] for field in fields}
        for end in ("source_id", "target_id"):
            columns[end] = ids.unpacked(record[end], "node")
        if "proof" in fields:
            columns["proof"] = record["proof"].withField("id", ids.unpacked(record["proof"]["id"], "evidence")).withField(
                "excerpt_hash", text.unpacked_hash(record["proof"]["excerpt_hash"]))
        return F.when(record.isNotNull(), F.struct(*[value.alias(field) for field, value in columns.items()]))

    return _opened_edges(pairs).withColumns({name: opened(name) for name in ("before", "after")})


# The signals of a rename with their weights, in the order they are added.
SIGNALS = ["body_fingerprint", "same_path", "signature_shape", "same_owner"]
WEIGHTS = {
    # Fixed values.
    "body_fingerprint": 0.65, "same_path": 0.15, "signature_shape": 0.15, "same_owner": 0.05,
}


def rename_score(present: set[str]) -> float:
    score = 0.0
    for name in SIGNALS:
        if name in present:
            score += WEIGHTS[name]
    return min(score, 1.0)


def _signals() -> list[Column]:
    """What renames compare of a node; its body as a mark, as only its equality counts."""

    return [
        F.col("kind"), F.col("language"), F.col("qualified_name"),
        _mark(F.nullif(F.col("body_fingerprint"), F.lit(""))).alias("body_fingerprint"),
        F.col("path").alias("same_path"),
        text.signature_shape(F.col("kind"), F.col("signature")).alias("signature_shape"),
    ]


def matched_columns() -> list[Column]:
    """The columns of a node that :func:`match_renames` reads."""

    return [F.col(name) for name in (*REPO, "id", "kind", "language", "qualified_name", "body_fingerprint", "path", "signature")]


def match_renames(
    removed: DataFrame, added: DataFrame, threshold: float = RENAME_THRESHOLD
) -> DataFrame:
    """Removed and added nodes that are each other's only best match; see :func:`_match`."""

    return _match(removed.select(*REPO, "id", *_signals()), added.select(*REPO, "id", *_signals()), threshold)


def _match(removed: DataFrame, added: DataFrame, threshold: float) -> DataFrame:
    """Nodes by their signals that are each other's only best match.

    A pair of nodes shares a set of signals, and the score depends on that set alone.  Each
    node therefore looks up, per set, how many nodes of the other side share at least that
    set; the best set with a partner gives its best score, and a count of one its partner.
    Only counts are joined, never pairs, so a fingerprint that a large share of all nodes
    carries (an empty body) costs one row per set instead of all its pairs.
    """

    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    sets = []
    for mask in range(2 ** len(SIGNALS)):
        present = [s for i, s in enumerate(SIGNALS) if mask >> i & 1]
        if rename_score(set(present)) >= threshold:
            sets.append(present)
    sets.sort(key=lambda s: -rename_score(set(s)))

    def keyed(nodes: DataFrame) -> DataFrame:
        rows = []
        for number, present in enumerate(sets):
            parts = [F.col(s) for s in present]
            whole = F.lit(True)
            for part in parts:
                whole = whole & part.isNotNull()
            rows.append(
                F.when(
                    whole,
                    F.struct(
                        F.lit(number).alias("set_no"),
                        F.lit(rename_score(set(present))).alias("score"),
                        # The language may be null on both sides; a null matches a null.
                        # Without any signal every node of the other side is a partner.
                        (
                            _mark(F.to_json(F.struct(F.col("kind"), F.col("language"), *parts)))
                            if present
                            else F.lit(b"")
                        ).alias("key"),
                    ),
                )
            )
        owned = nodes.withColumn("same_owner", text.owner_name(F.col("qualified_name")))
        return owned.withColumn("at", F.explode(F.array_compact(F.array(*rows)))).select(
            *REPO, ids.packed(F.col("id"), "node").alias("id"), "qualified_name", "at.*"
        )

    def best(mine: DataFrame, other: DataFrame) -> DataFrame:
        partners = other.groupBy(*REPO, "set_no", "key").agg(
            F.count(F.lit(1)).alias("partners"), F.min("id").alias("partner"),
        )
        hits = mine.join(partners, REPO + ["set_no", "key"])
        # Sets of the best score hold no further shared signal, so their partners are disjoint.
        levels = hits.groupBy(*REPO, "id", "qualified_name", "score").agg(
            F.sum("partners").alias("partners"), F.min("partner").alias("partner"),
            F.min("set_no").alias("set_no"),
        )
        return (
            levels.groupBy(*REPO, "id", "qualified_name")
            .agg(F.max_by(F.struct("score", "partners", "partner", "set_no"), "score").alias("top"))
            .where(F.col("top.partners") == 1)
            .select(*REPO, "id", "qualified_name", "top.score", "top.partner", "top.set_no")
        )

    left, right = keyed(removed), keyed(added)
    old = best(left, right).select(
        *REPO, F.col("id").alias("before_node_id"), F.col("partner").alias("after_node_id"),
        F.col("qualified_name").alias("before_name"), "score", "set_no",
    )
    new = best(right, left).select(
        *REPO, F.col("id").alias("after_node_id"), F.col("partner").alias("before_node_id"),
        F.col("qualified_name").alias("after_name"), F.col("score").alias("after_score"),
    )
    signals = F.array(
        *[F.array(*[F.lit(s) for s in present]).cast("array<string>") for present in sets]
    )
    matched = old.join(new, REPO + ["before_node_id", "after_node_id"]).where(
        F.col("score") == F.col("after_score")
    )
    return matched.select(
        *REPO, *[ids.unpacked(F.col(name), "node").alias(name) for name in ("before_node_id", "after_node_id")], "score",
        F.get(signals, F.col("set_no")).alias("matched_signals"), "before_name", "after_name",
    )


def quality_changes(changes: DataFrame) -> DataFrame:
    """Removed and added edges of one (source, predicate, target) whose quality differs.

    Of several edges per side the one with the highest id counts.
    """

    fact = REPO + ["source_id", "predicate", "target_id"]
    ends = ("source_id", "target_id")

    def side(change: str, name: str) -> DataFrame:
        return (
            changes.where(F.col("change") == change)
            .select(*REPO, *[ids.packed(F.col(f"{name}.{end}"), "node").alias(end) for end in ends], f"{name}.predicate",
                    F.when(F.col("id").isNotNull(), F.struct("id", f"{name}.quality")).alias(name))
            .repartition(*fact).groupBy(*fact)
            .agg(F.max(name).alias(name))
        )

    return (
        side("removed", "before").join(side("added", "after"), fact)
        .where(F.col("before.quality") != F.col("after.quality"))
        .withColumns({end: ids.unpacked(F.col(end), "node") for end in ends})
        .select(
            *fact, F.col("before.id").alias("before_edge_id"),
            F.col("after.id").alias("after_edge_id"),
            F.col("before.quality").alias("before_quality"),
            F.col("after.quality").alias("after_quality"),
        )
    )


def structural_warnings(
    changes: DataFrame, quality: DataFrame, before_edges: DataFrame, after_edges: DataFrame
) -> DataFrame:
    """(repository_id, warning, amount): removed TESTS relations and new dependency cycles."""

    tests = (
        changes.where((F.col("change") == "removed") & (F.col("before.predicate") == "TESTS"))
        .join(quality.select(*REPO, F.col("before_edge_id").alias("id")), REPO + ["id"], "left_anti")
        .groupBy(*REPO)
        .agg(F.count(F.lit(1)).alias("amount"))
        .withColumn(
            "warning",
            F.format_string("%d exact TESTS relation(s) were removed.", F.col("amount")),
        )
    )
    cycles = (
        scc.new_cycles(scc.cycles(before_edges), scc.cycles(after_edges))
        .groupBy(*REPO)
        .agg(F.count(F.lit(1)).alias("amount"))
        .withColumn(
            "warning",
            F.format_string(
                "%d new exact dependency cycle(s) were introduced.", F.col("amount")
            ),
        )
    )
    return tests.select(*REPO, "warning", "amount").unionByName(
        cycles.select(*REPO, "warning", "amount")
    )


def compare(
    before_nodes: DataFrame,
    before_edges: DataFrame,
    after_nodes: DataFrame,
    after_edges: DataFrame,
    rename_threshold: float = RENAME_THRESHOLD,
    with_cycles: bool = True,
    with_proofs: bool = False,
) -> dict[str, DataFrame]:
    """The delta of two revisions as one table per record type.

    ``nodes`` and ``edges`` hold every raw change; ``added_nodes`` and ``removed_nodes`` leave
    out renamed nodes, ``added_edges`` and ``removed_edges`` edges whose quality changed.
    ``node_marks`` and ``edge_marks`` are the same changes with ids, signals and ends in place of records. They are stored
    once and all other tables are read off them, so records move only for readers who take ``nodes`` or ``edges``.
    ``with_proofs`` adds what the evidence of a change is made of: the place of a node and the first evidence of an edge.
    """

    place = [F.col("content_hash"), F.col("span")] if with_proofs else []
    node_keys, edge_keys = _changed_nodes(before_nodes, after_nodes), _changed_edges(before_edges, after_edges)
    nodes = _opened_nodes(cut(_node_pairs(before_nodes, after_nodes, node_keys, [*_signals(), *place])))
    edges = _opened_ends(cut(_edge_pairs(before_edges, after_edges, edge_keys, _packed_ends(with_proofs))))

    def side(change: str, name: str) -> DataFrame:
        return nodes.where(F.col("change") == change).select(*REPO, "id", f"{name}.*")

    removed, added = side("removed", "before"), side("added", "after")
    renames = cut(_match(removed, added, rename_threshold))
    quality = cut(quality_changes(edges))

    def without(df: DataFrame, other: DataFrame, column: str) -> DataFrame:
        return df.join(other.select(*REPO, F.col(column).alias("id")), REPO + ["id"], "left_anti")

    delta = {
        "nodes": node_changes(before_nodes, after_nodes, keys=node_keys),
        "edges": edge_changes(before_edges, after_edges, keys=edge_keys),
        "node_marks": nodes,
        "edge_marks": edges,
        "added_nodes": without(added.select(*REPO, "id"), renames, "after_node_id"),
        "removed_nodes": without(removed.select(*REPO, "id"), renames, "before_node_id"),
        "modified_nodes": nodes.where(F.col("change") == "modified").select(
            *REPO, "id", "changed_fields"
        ),
        "renamed_nodes": renames,
        "added_edges": without(
            edges.where(F.col("change") == "added").select(*REPO, "id"), quality, "after_edge_id"
        ),
        "removed_edges": without(
            edges.where(F.col("change") == "removed").select(*REPO, "id"), quality,
            "before_edge_id",
        ),
        "evidence_moves": edges.where(F.col("change") == "evidence_moved").select(
            *REPO, "id", "before_evidence_ids", "after_evidence_ids"
        ),
        "quality_changes": quality,
    }
    if with_cycles:
        delta["warnings"] = structural_warnings(edges, quality, before_edges, after_edges)
    return delta


def change_counts(delta: dict[str, DataFrame]) -> DataFrame:
    """(repository_id, record, amount) for every record type that occurs."""

    parts = [
        delta[name].select(*REPO, F.lit(name).alias("record"))
        for name in ("added_nodes", "removed_nodes", "modified_nodes", "renamed_nodes",
                     "added_edges", "removed_edges", "evidence_moves", "quality_changes",
                     "warnings")
        if name in delta
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy(*REPO, "record").agg(F.count(F.lit(1)).alias("amount"))


def verify_delta(given: dict[str, DataFrame], fresh: dict[str, DataFrame]) -> DataFrame:
    """Rows by which a stored delta differs from a fresh comparison; none when it holds.

    A table that only one of the two has differs by all its rows.
    """

    def row(df: DataFrame) -> DataFrame:
        return df.select(*REPO, F.to_json(F.struct(*sorted(df.columns))).alias("row"))

    parts = []
    for name in sorted({*given, *fresh} - {"nodes", "edges", "node_marks", "edge_marks"}):
        some = row(fresh[name] if name in fresh else given[name])
        stored = row(given[name]) if name in given else some.limit(0)
        wanted = row(fresh[name]) if name in fresh else some.limit(0)
        parts.append(
            stored.exceptAll(wanted).select(*REPO, F.lit(name).alias("record"),
                                            F.lit("not in comparison").alias("problem"), "row")
        )
        parts.append(
            wanted.exceptAll(stored).select(*REPO, F.lit(name).alias("record"),
                                            F.lit("missing").alias("problem"), "row")
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
