"""Queries on the event table read as agent events."""

from __future__ import annotations

from pyspark.sql import functions as F

from repograph.operators import observe
from repograph.plans import fixtures
from repograph.plans.catalog import register
from repograph.streaming import events as streaming

EVENTS = """WITH agent AS (SELECT 'e' || event_id AS event_id, 's' || user_id AS session_id, ts,
    event_id AS seq, json_extract_string(props, '$.k') AS item,
    CASE event_type WHEN 'signup' THEN 'traversal_entered' WHEN 'click' THEN 'traversal_followed'
      WHEN 'view' THEN 'traversal_followed' WHEN 'error' THEN 'traversal_abandoned'
      ELSE 'evidence_opened' END AS type FROM events)"""
TRACKS = f"""{EVENTS}, steps AS (SELECT *, lag(type) OVER w AS before FROM agent
      WHERE type LIKE 'traversal%' WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)),
    marked AS (SELECT *, sum(CASE WHEN before IS NULL OR type = 'traversal_entered'
      OR before = 'traversal_abandoned' THEN 1 ELSE 0 END) OVER (
        PARTITION BY session_id ORDER BY ts, seq) - 1 AS track FROM steps)
    SELECT session_id, event_id, track::BIGINT AS track_index,
      row_number() OVER (PARTITION BY session_id, track ORDER BY ts, seq) - 1 AS step_index
    FROM marked"""


@register("traversal_tracks", TRACKS)
def traversal_tracks(spark, sf_dir):
    tracks = observe.traversal_tracks(fixtures.agent_events(spark, sf_dir))
    return tracks.select("session_id", "event_id", "track_index", "step_index")


@register("stream_tracks", TRACKS)
def stream_tracks(spark, sf_dir):
    """The same tracks from a drained stream."""

    stream = fixtures.agent_event_stream(spark, sf_dir)
    found = streaming.drain(streaming.stream_tracks(streaming.first_arrivals(stream, "1 day")))
    return found.select("session_id", "event_id", "track_index", "step_index")


ITEMS = f"""{EVENTS} SELECT 'view-' || strftime(ts, '%Y-%m-%d') AS view_id, 'node' AS item_kind,
    item AS item_id, CASE WHEN bool_or(type = 'evidence_opened') THEN 'opened' ELSE 'returned' END
      AS state FROM agent WHERE type <> 'traversal_abandoned' GROUP BY 1, 2, 3"""


@register("item_states", ITEMS)
def item_states(spark, sf_dir):
    states = observe.item_states(fixtures.agent_events(spark, sf_dir))
    return states.select("view_id", "item_kind", "item_id", "state")


@register("stream_item_states", ITEMS)
def stream_item_states(spark, sf_dir):
    stream = observe.valid_events(fixtures.agent_event_stream(spark, sf_dir))
    found = streaming.drain(observe.item_states(stream), "update")
    keys = ["view_id", "item_kind", "item_id"]
    return found.groupBy(*keys).agg(F.max_by("state", "batch").alias("state"))


@register(
    "timeline",
    f"""{EVENTS} SELECT event_id, type AS state, CASE type
        WHEN 'traversal_entered' THEN 'Walk begun'
        WHEN 'traversal_followed' THEN 'Edge followed'
        WHEN 'traversal_abandoned' THEN 'Walk left'
        ELSE 'Evidence opened' END AS label,
      CASE type WHEN 'traversal_entered' THEN 'A walk through the graph began here.'
        WHEN 'traversal_followed' THEN 'The walk went on along an edge.'
        WHEN 'traversal_abandoned' THEN 'The walk was given up here.'
        ELSE 'The lines behind a statement were opened.' END || ' 1 entity referenced.' AS detail
    FROM agent ORDER BY ts DESC, seq DESC LIMIT 200""",
)
def timeline(spark, sf_dir):
    rows = observe.timeline(fixtures.agent_events(spark, sf_dir))
    return rows.select("event_id", "label", "detail", "state")


# Each session polls from its second event in the retained history, and from a lost one.
@register(
    "replay",
    f"""{EVENTS}, kept AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq)
        AS n FROM (SELECT * FROM agent ORDER BY ts DESC, seq DESC LIMIT 500)),
    cursors AS (SELECT session_id, event_id AS cursor FROM kept WHERE n = 2)
    SELECT k.session_id, cursor, k.event_id, false AS gap FROM kept k
      JOIN cursors c ON k.session_id = c.session_id WHERE n > 2
    UNION ALL SELECT DISTINCT session_id, 'lost', NULL, true FROM agent""",
)
def replay(spark, sf_dir):
    from pyspark.sql.window import Window

    events = fixtures.agent_events(spark, sf_dir)
    order = Window.partitionBy("session_id").orderBy("timestamp", "seq")
    second = observe.last_n(events).withColumn("n", F.row_number().over(order)).where("n = 2")
    cursors = second.select("session_id", F.col("event_id").alias("cursor")).unionByName(
        events.select("session_id", F.lit("lost").alias("cursor")).distinct()
    )
    return observe.replay(events, cursors).drop("type")


# A session starts with the first event of a user and day and ends with a purchase.
LIFE = """WITH ranked AS (SELECT 's' || user_id || strftime(ts, '-%d') AS session_id, ts, event_id,
      user_id, event_type, row_number() OVER (PARTITION BY user_id, strftime(ts, '-%d')
        ORDER BY ts, event_id) AS n FROM events),
    ends AS (SELECT session_id, min(ts) FILTER (n = 1 AND user_id % 7 <> 0) AS started_at,
      min(ts) FILTER (event_type = 'purchase' AND n > 1) AS completed_at FROM ranked GROUP BY 1),
    lives AS (SELECT e.session_id, CASE WHEN started_at IS NULL THEN 'unknown'
        WHEN completed_at IS NULL THEN 'active' ELSE 'completed' END AS state,
      started_at, completed_at, count(*) FILTER (ts > completed_at) AS late_events
    FROM ends e JOIN ranked r USING (session_id) GROUP BY ALL)"""


@register("sessions", f"{LIFE} SELECT session_id, state, late_events FROM lives")
def sessions(spark, sf_dir):
    found = observe.sessions(fixtures.session_events(spark, sf_dir))
    return found.select("session_id", "state", "late_events")


@register("stream_sessions", f"{LIFE} SELECT session_id, state, late_events FROM lives")
def stream_sessions(spark, sf_dir):
    """The same from a stream whose files come in no order."""

    stream = fixtures.session_event_stream(spark, sf_dir)
    found = streaming.drain(streaming.session_state(stream, "36500 days"), "update")
    return found.groupBy("session_id").agg(
        F.max_by("state", "batch").alias("state"), F.max_by("late_events", "batch").alias("late_events"))


@register(
    "active_sessions",
    f"""{LIFE}, moves AS (SELECT session_id, started_at AS moved_at, 1 AS delta FROM lives
        WHERE started_at IS NOT NULL
      UNION ALL SELECT session_id, completed_at, -1 FROM lives
        WHERE started_at IS NOT NULL AND completed_at IS NOT NULL),
    counted AS (SELECT *, coalesce(sum(delta) OVER (ORDER BY moved_at, delta, session_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS active_before FROM moves)
    SELECT session_id, active_before FROM counted WHERE delta = 1 AND active_before >= 32""",
)
def active_sessions(spark, sf_dir):
    found = observe.sessions(fixtures.session_events(spark, sf_dir))
    return observe.over_limit_starts(found).select("session_id", "active_before")


@register(
    "latest_view",
    """SELECT 's' || user_id AS session_id, 'view-' || strftime(max(ts), '%Y-%m-%d') AS view_id
    FROM events WHERE event_type = 'purchase' GROUP BY user_id""",
)
def latest_view(spark, sf_dir):
    events = fixtures.agent_events(spark, sf_dir).withColumn(
        "type", F.when(F.col("type") == "evidence_opened", "result_returned").otherwise(F.col("type"))
    )
    return observe.latest_view(events).select("session_id", "view_id")


@register(
    "event_checks",
    """SELECT CASE WHEN event_type = 'error' THEN 'type' WHEN event_id % 11 = 0 THEN 'event_id'
        WHEN event_id % 13 = 0 THEN 'metadata' END AS problem, count(*) AS amount
    FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'x' ELSE event_type END AS event_type
          FROM events) GROUP BY 1""",
)
def event_checks(spark, sf_dir):
    """Damaged events: blank ids, unknown types, metadata that is no object."""

    events = fixtures.agent_events(spark, sf_dir)
    damaged = events.withColumns({
        "event_id": F.when(F.col("seq") % 11 == 0, F.lit("  ")).otherwise(F.col("event_id")),
        "type": F.when(F.col("type") == "traversal_abandoned", "gone").otherwise(F.col("type")),
        "metadata": F.when(F.col("seq") % 13 == 0, "[1]").otherwise('{"a": 1}'),
    })
    return observe.check_events(damaged).groupBy("problem").agg(F.count(F.lit(1)).alias("amount"))


@register(
    "event_log",
    """SELECT event_id, max(n) AS copies FROM (
      SELECT 'e' || event_id AS event_id, (CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END)::BIGINT AS n
      FROM events) GROUP BY event_id""",
)
def event_log(spark, sf_dir):
    """Every fifth event arrives twice; the log holds the first copy."""

    events = fixtures.agent_events(spark, sf_dir).withColumn("copies", F.lit(1).cast("bigint"))
    again = events.where(F.col("seq") % 5 == 0).withColumn("seq", F.col("seq") + 1_000_000_000_000)
    marked = events.withColumn("copies", F.when(F.col("seq") % 5 == 0, 2).otherwise(1).cast("bigint"))
    return observe.event_log(marked.unionByName(again)).select("event_id", "copies")
