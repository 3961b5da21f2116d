"""Agent event logs: validation, order, sessions, traversal tracks, item states, timeline.

Events: event_id, session_id, timestamp, type, revision_id, view_id, entity_ids,
relationship_ids, metadata, and ``seq``, the arrival order that breaks ties of the timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repograph import constants as K
from repograph.functions.ids import strip

CONTROL = r"[\x00-\x1f\x7f]"


def _bounded(value: Column, limit: int = 256) -> Column:
    """A trimmed id, or null when it is blank, too long or holds control characters."""

    bare = strip(value)
    return F.when((bare != "") & (F.length(bare) <= limit) & ~bare.rlike(CONTROL), bare)


def _references(values: Column) -> Column:
    bare = F.transform(values, lambda v: _bounded(v, 1_024))
    fine = (F.size(values) <= K.MAX_EVENT_REFERENCES) & ~F.exists(bare, lambda v: v.isNull())
    return F.when(fine, F.array_distinct(bare))


def check_events(df: DataFrame) -> DataFrame:
    """Normalised events with ``problem``: the first broken rule, or null for a valid event.

    Works on batches and streams.  ``timestamp`` may be text or a timestamp.
    """

    metadata = F.col("metadata")
    bad_metadata = metadata.isNotNull() & ~F.coalesce(
        (F.length(metadata) <= K.MAX_EVENT_METADATA)
        & (F.schema_of_variant(F.try_parse_json(metadata)).startswith("OBJECT")),
        F.lit(False),
    )
    kind = dict(df.dtypes)["timestamp"]
    parsed = (
        F.try_to_timestamp("timestamp") if kind == "string" else F.col("timestamp").cast("timestamp")
    )
    view = _bounded(F.col("view_id"))
    clean = {
        "event_id": _bounded(F.col("event_id")),
        "session_id": _bounded(F.col("session_id")),
        "revision_id": _bounded(F.col("revision_id")),
        "timestamp": parsed,
        "type": F.when(F.col("type").isin(*K.EVENT_TYPES), F.col("type")),
        "entity_ids": _references(F.col("entity_ids")),
        "relationship_ids": _references(F.col("relationship_ids")),
    }
    problem = F.coalesce(
        *[F.when(value.isNull(), F.lit(name)) for name, value in clean.items()],
        F.when(F.col("view_id").isNotNull() & view.isNull(), F.lit("view_id")),
        F.when(bad_metadata, F.lit("metadata")),
    )
    return df.withColumn("problem", problem).withColumns({**clean, "view_id": view})


def valid_events(df: DataFrame) -> DataFrame:
    return check_events(df).where(F.col("problem").isNull()).drop("problem")


def event_log(df: DataFrame) -> DataFrame:
    """One row per event id: the first to arrive."""

    columns = df.columns
    return df.groupBy("event_id").agg(
        F.min_by(F.struct(*columns), "seq").alias("e")
    ).select(*[F.col(f"e.{c}") for c in columns])


def last_n(events: DataFrame, n: int = K.EVENT_HISTORY) -> DataFrame:
    """The last events by time and arrival; every task passes on at most ``n``."""

    return events.orderBy(F.desc("timestamp"), F.desc("seq")).limit(n)


def revision_conflicts(events: DataFrame, session_table: DataFrame) -> DataFrame:
    """Events that name another revision than their session."""

    known = session_table.select("session_id", F.col("revision_id").alias("session_revision"))
    return events.join(known, "session_id").where(F.col("revision_id") != F.col("session_revision"))


def sessions(events: DataFrame) -> DataFrame:
    """(session_id, revision_id, state, started_at, completed_at, late_events).

    ``state`` is active, completed or unknown (no start); ``late_events`` came after the end.
    """

    at = F.struct("timestamp", "seq")
    of = lambda kind, value: F.when(F.col("type") == kind, value)
    ends = events.groupBy("session_id").agg(
        F.min(of("session_started", F.struct("timestamp", "seq", "revision_id"))).alias("start"),
        F.min(of("session_completed", at)).alias("end"),
    )
    late = (
        events.join(ends.where(F.col("end").isNotNull()).select("session_id", "end"), "session_id")
        .where(at > F.col("end"))
        .groupBy("session_id").agg(F.count(F.lit(1)).alias("late_events"))
    )
    state = (
        F.when(F.col("start").isNull(), "unknown")
        .when(F.col("end").isNull(), "active")
        .otherwise("completed")
    )
    return ends.join(late, "session_id", "left").select(
        "session_id", F.col("start.revision_id").alias("revision_id"), state.alias("state"),
        F.col("start.timestamp").alias("started_at"), F.col("end.timestamp").alias("completed_at"),
        F.coalesce("late_events", F.lit(0)).alias("late_events"),
    )


def active_counts(session_table: DataFrame, bucket: str = "hour") -> DataFrame:
    """(session_id, started_at, active_before): sessions open when a session starts.

    Running totals in two steps: totals per time bucket, then inside each bucket.
    """

    moves = (
        session_table.where(F.col("started_at").isNotNull())
        .select("session_id", F.explode(F.array(
            F.struct(F.col("started_at").alias("at"), F.lit(1).alias("delta")),
            F.struct(F.col("completed_at").alias("at"), F.lit(-1).alias("delta")),
        )).alias("m"))
        .select("session_id", "m.*")
        .where(F.col("at").isNotNull())
        .withColumn("bucket", F.date_trunc(bucket, "at"))
    )
    ordered = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per time bucket: the whole history of a service is a few thousand rows.
    offsets = (
        moves.groupBy("bucket").agg(F.sum("delta").alias("moved"))
        .select("bucket", F.coalesce(F.sum("moved").over(ordered), F.lit(0)).alias("offset"))
    )
    inside = (
        Window.partitionBy("bucket").orderBy("at", "delta", "session_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        moves.withColumn("inner", F.coalesce(F.sum("delta").over(inside), F.lit(0)))
        .join(offsets, "bucket")
        .where(F.col("delta") == 1)
        .select("session_id", F.col("at").alias("started_at"),
                (F.col("offset") + F.col("inner")).alias("active_before"))
    )


def over_limit_starts(session_table: DataFrame, limit: int = K.MAX_ACTIVE_SESSIONS) -> DataFrame:
    """Sessions that started while ``limit`` others were open."""

    return active_counts(session_table).where(F.col("active_before") >= limit)


def sole_active_session(session_table: DataFrame) -> DataFrame:
    """One row: ``resolved`` with the only active session, else ``none`` or ``ambiguous``."""

    active = session_table.where(F.col("state") == "active")
    return active.agg(F.count(F.lit(1)).alias("n"), F.min("session_id").alias("s")).select(
        F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
        .alias("status"),
        F.when(F.col("n") == 1, F.col("s")).alias("session_id"),
    )


def replay(events: DataFrame, cursors: DataFrame, history: int = K.EVENT_HISTORY) -> DataFrame:
    """Events after a cursor in its session, within the retained history of all sessions.

    ``cursors`` has (session_id, cursor).  A cursor that is not retained gives one row with
    ``gap`` true and no event.
    """

    kept = last_n(events, history)
    at = F.struct("timestamp", "seq")
    anchor = kept.select("session_id", F.col("event_id").alias("cursor"), at.alias("cursor_at"))
    placed = cursors.join(anchor, ["session_id", "cursor"], "left")
    later = (
        kept.select("session_id", "event_id", "type", at.alias("at"))
        .join(placed.where(F.col("cursor_at").isNotNull()), "session_id")
        .where(F.col("at") > F.col("cursor_at"))
        .select("session_id", "cursor", "event_id", "type", F.lit(False).alias("gap"))
    )
    gaps = placed.where(F.col("cursor_at").isNull()).select(
        "session_id", "cursor", F.lit(None).cast("string").alias("event_id"),
        F.lit(None).cast("string").alias("type"), F.lit(True).alias("gap"),
    )
    return later.unionByName(gaps)


def latest_view(events: DataFrame) -> DataFrame:
    """The view that each session was given last."""

    given = events.where(
        (F.col("type") == "result_returned") & (F.coalesce("view_id", F.lit("")) != "")
    )
    return given.groupBy("session_id").agg(
        F.max_by(F.struct("view_id", "revision_id"), F.struct("timestamp", "seq")).alias("v")
    ).select("session_id", "v.*")


def _pick(mapping: dict[str, str], column: str) -> Column:
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.col(column))


def traversal_tracks(events: DataFrame, bucket: str = "hour") -> DataFrame:
    """Traversal events with ``track_index`` and ``step_index`` in their session.

    A track starts at the first event, at ``entered`` and after ``abandoned``.  A session may
    hold a large share of all events, so positions are counted inside (session, time bucket)
    and the buckets of a session, few rows each, pass on where they ended.
    """

    action = _pick(K.TRAVERSAL_ACTIONS, "type")
    rows = (
        events.withColumn("action", action).where(F.col("action").isNotNull())
        .withColumn("bucket", F.date_trunc(bucket, "timestamp"))
    )
    key = ["session_id", "bucket"]
    inside = Window.partitionBy(*key).orderBy("timestamp", "seq")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    # The first row of a bucket needs the bucket before it, so its mark is set later.
    mark = (F.col("place") > 1) & (
        (F.col("action") == "enter") | (F.col("previous") == "abandon")
    )
    rows = (
        rows.withColumn("place", F.row_number().over(inside))
        .withColumn("previous", F.lag("action").over(inside))
        .withColumn("mark", F.coalesce(mark, F.lit(False)).cast("int"))
        .withColumn("marks", F.sum("mark").over(so_far))
        .withColumn("marked_at", F.max(F.when(F.col("mark") == 1, F.col("place"))).over(so_far))
    )
    ends = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("mark").alias("inner_marks"),
        F.max("marked_at").alias("last_mark"), F.min_by("action", "place").alias("first_action"),
        F.max_by("action", "place").alias("last_action"),
    )
    across = Window.partitionBy("session_id").orderBy("bucket")
    upto = across.rowsBetween(Window.unboundedPreceding, 0)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    opens = (
        F.col("before_action").isNull()
        | (F.col("before_action") == "abandon")
        | (F.col("first_action") == "enter")
    )
    ends = (
        ends.withColumn("before_action", F.lag("last_action").over(across))
        .withColumn("opens", opens.cast("int"))
        .withColumn("last_mark", F.coalesce("last_mark", F.when(F.col("opens") == 1, F.lit(1))))
        # Steps that a bucket adds to the track left open at its end.
        .withColumn("tail", F.when(F.col("last_mark").isNull(), F.col("n")).otherwise(
            F.col("n") - F.col("last_mark") + 1))
        .withColumn("tails", F.sum("tail").over(upto))
        .withColumn("base", F.last(
            F.when(F.col("last_mark").isNotNull(), F.col("tails") - F.col("tail")), True
        ).over(upto))
        .withColumn("carried", F.lag(F.col("tails") - F.col("base")).over(across))
        .withColumn("tracks", F.coalesce(
            F.sum(F.col("inner_marks") + F.col("opens")).over(before), F.lit(0)))
        .select(*key, "opens", "tracks", F.coalesce("carried", F.lit(0)).alias("carried"))
    )
    started = F.coalesce("marked_at", F.when(F.col("opens") == 1, F.lit(1)))
    step = F.when(started.isNotNull(), F.col("place") - started).otherwise(
        F.col("carried") + F.col("place") - 1
    )
    return rows.join(ends, key).select(
        "session_id", "event_id", "timestamp", "seq", "action", "entity_ids", "relationship_ids",
        (F.col("tracks") + F.col("opens") + F.col("marks") - 1).cast("bigint").alias("track_index"),
        step.cast("bigint").alias("step_index"),
    )


def _state_rows(events: DataFrame, ids: str, mapping: dict[str, str], item: str) -> DataFrame:
    order = F.array(*[F.lit(s) for s in K.ITEM_STATES])
    state = _pick(mapping, "type")
    return events.where(state.isNotNull()).select(
        "view_id", "revision_id", F.lit(item).alias("item_kind"), F.explode(ids).alias("item_id"),
        F.array_position(order, state).alias("strength"),
    )


def item_states(events: DataFrame) -> DataFrame:
    """The strongest state of each node and edge in each (view, revision): edited over opened
    over selected over returned.  Also valid on a stream in update mode."""

    rows = _state_rows(events, "entity_ids", K.NODE_STATE_OF_EVENT, "node").unionByName(
        _state_rows(events, "relationship_ids", K.EDGE_STATE_OF_EVENT, "edge")
    )
    strongest = rows.groupBy("view_id", "revision_id", "item_kind", "item_id").agg(
        F.max("strength").alias("strength")
    )
    names = F.array(*[F.lit(s) for s in K.ITEM_STATES])
    return strongest.select(
        "view_id", "revision_id", "item_kind", "item_id",
        F.element_at(names, F.col("strength").cast("int")).alias("state"),
    )


def timeline(events: DataFrame, n: int = K.TIMELINE_ROWS) -> DataFrame:
    """The last events as (event_id, label, detail, state, timestamp)."""

    labels = _pick({k: v[0] for k, v in K.EVENT_LABELS.items()}, "type")
    details = _pick({k: v[1] for k, v in K.EVENT_LABELS.items()}, "type")

    def amount(ids: str, one: str, many: str) -> Column:
        n_ids = F.size(ids)
        return F.when(
            n_ids > 0,
            F.concat_ws(" ", n_ids.cast("string"), F.when(n_ids == 1, one).otherwise(many)),
        )

    refs = F.concat_ws(
        " and ", amount("entity_ids", "entity", "entities"),
        amount("relationship_ids", "relationship", "relationships"),
    )
    return last_n(events, n).select(
        "event_id", labels.alias("label"),
        F.when(refs == "", details)
        .otherwise(F.concat(details, F.lit(" "), refs, F.lit(" referenced."))).alias("detail"),
        F.col("type").alias("state"), "timestamp",
    )


def check_selection(view_nodes: DataFrame, view_edges: DataFrame, picks: DataFrame) -> DataFrame:
    """(view_id, item_kind, item_id, action, problem) for every refused pick.

    ``picks`` has (view_id, item_kind, item_id, action); action is pin, select or open.  An
    item must be in the view; opening needs a path and line range of the node, or an evidence
    record of the edge with both.
    """

    def placed(path: Column, start: Column, end: Column) -> Column:
        return F.coalesce((path != ".") & (start > 0) & (end > 0), F.lit(False))

    nodes = view_nodes.select(
        "view_id", F.lit("node").alias("item_kind"), F.col("id").alias("item_id"),
        placed(F.col("path"), F.col("span.start_line"), F.col("span.end_line")).alias("openable"),
    )
    edges = view_edges.select(
        "view_id", F.lit("edge").alias("item_kind"), F.col("id").alias("item_id"),
        F.exists("evidence", lambda e: placed(e["path"], e["start_line"], e["end_line"])).alias(
            "openable"
        ),
    )
    items = nodes.unionByName(edges).withColumn("known", F.lit(True))
    problem = F.when(F.col("known").isNull(), "unknown").when(
        (F.col("action") == "open") & ~F.coalesce("openable", F.lit(False)), "no_evidence"
    )
    return (
        picks.join(items, ["view_id", "item_kind", "item_id"], "left")
        .withColumn("problem", problem)
        .where(F.col("problem").isNotNull())
        .select("view_id", "item_kind", "item_id", "action", "problem")
    )
