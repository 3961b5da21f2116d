"""Agent events as Structured Streaming queries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from repograph import constants as K
from repograph.operators import observe
from repograph.session import run_folder

EVENT_ROWS = (
    "event_id STRING, session_id STRING, timestamp STRING, type STRING, revision_id STRING, "
    "view_id STRING, entity_ids ARRAY<STRING>, relationship_ids ARRAY<STRING>, "
    "metadata STRING, seq BIGINT"
)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event files as a batch."""

    return spark.read.schema(EVENT_ROWS).json(path)


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Event files as a stream; a trigger takes a bounded number of files."""

    return (
        spark.readStream.schema(EVENT_ROWS).option("maxFilesPerTrigger", files_per_trigger).json(path)
    )


def first_arrivals(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Valid events, each event id once while it lies inside the watermark."""

    return (
        observe.valid_events(events)
        .withWatermark("timestamp", delay)
        .dropDuplicatesWithinWatermark(["event_id"])
    )


TRACK_ROWS = (
    "session_id STRING, event_id STRING, action STRING, track_index BIGINT, step_index BIGINT"
)
TRACK_STATE = "tracks BIGINT, steps BIGINT, open BOOLEAN"


def _follow(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Number the events of one session in one trigger, going on from the stored position."""

    tracks, steps, is_open = state.get if state.exists else (0, 0, False)
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["timestamp", "seq"])
    out = []
    for event_id, action in zip(rows["event_id"], rows["action"]):
        if not is_open or action == "enter":
            tracks, steps = tracks + 1, 0
        out.append((key[0], event_id, action, tracks - 1, steps))
        steps, is_open = steps + 1, action != "abandon"
    state.update((tracks, steps, is_open))
    yield pd.DataFrame(
        out, columns=["session_id", "event_id", "action", "track_index", "step_index"]
    )


def stream_tracks(events: DataFrame) -> DataFrame:
    """Traversal tracks of a stream.  Sessions are the state keys; order inside a trigger is by
    time, between triggers by arrival."""

    action = observe._pick(K.TRAVERSAL_ACTIONS, "type")
    rows = events.withColumn("action", action).where(F.col("action").isNotNull())
    return (
        rows.select("session_id", "event_id", "timestamp", "seq", "action")
        .groupBy("session_id")
        .applyInPandasWithState(
            _follow, TRACK_ROWS, TRACK_STATE, "append", GroupStateTimeout.NoTimeout
        )
    )


SESSION_ROWS = "session_id STRING, revision_id STRING, state STRING, late_events BIGINT"
# The state of a bucket of sessions, a row per session.  Positions are (microseconds, seq); a start also names its
# revision, and ``expires`` (milliseconds) is when the session is forgotten.
SESSION_STATE = (
    "held ARRAY<STRUCT<session_id: STRING, revision_id: STRING, start_at: BIGINT, start_seq: BIGINT, "
    "end_at: BIGINT, end_seq: BIGINT, settled_late: BIGINT, expires: BIGINT, recent_at: ARRAY<BIGINT>, "
    "recent_seq: ARRAY<BIGINT>>>"
)
FIRST, LAST = -(2**63), 2**63 - 1
#: State keys: a call of the worker costs about as much as some hundred events, so it takes a bucket of sessions.
SESSION_BUCKETS = 1024


def _session(idle_ms: int):
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Earliest start, earliest end and the events behind it of each session, whatever order rows come in.

        An end below the watermark is final, so events below it are only counted.
        """

        watermark = state.getCurrentWatermarkMs()
        settled = (watermark * 1000, FIRST)
        held = {row[0]: row[1:] for row in state.get[0]} if state.exists else {}
        touched: dict[str, list[tuple]] = {}
        if not state.hasTimedOut:
            for batch in batches:
                micros = batch["timestamp"].to_numpy("datetime64[us]").astype("int64").tolist()
                for session, at, seq, kind, of in zip(
                        batch["session_id"], micros, batch["seq"].tolist(), batch["type"], batch["revision_id"]):
                    touched.setdefault(session, []).append((at, seq, kind, of))
        out = []
        for session, events in touched.items():
            revision, start_at, start_seq, end_at, end_seq, late, _, times, seqs = held.get(
                session, (None, LAST, LAST, LAST, LAST, 0, 0, (), ()))
            start, end = (start_at, start_seq), (end_at, end_seq)
            recent = list(zip(times, seqs))
            newest = FIRST
            for at, seq, kind, of in events:
                recent.append((at, seq))
                newest = max(newest, at)
                if kind == "session_started" and (at, seq) < start:
                    start, revision = (at, seq), of
                elif kind == "session_completed":
                    end = min(end, (at, seq))
            late += sum(end < p < settled for p in recent)
            recent = [p for p in recent if p >= settled]
            held[session] = (revision, *start, *end, late, max(newest // 1000, watermark) + idle_ms,
                             [p[0] for p in recent], [p[1] for p in recent])
            name = "unknown" if start[0] == LAST else "active" if end[0] == LAST else "completed"
            out.append((session, revision, name, late + sum(p > end for p in recent)))
        held = {session: row for session, row in held.items() if session in touched or row[6] >= watermark}
        if held:
            state.update(([(session, *row) for session, row in held.items()],))
            state.setTimeoutTimestamp(max(min(row[6] for row in held.values()), watermark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["session_id", "revision_id", "state", "late_events"])

    return advance


def session_state(events: DataFrame, idle: str = "1 day", buckets: int = SESSION_BUCKETS) -> DataFrame:
    """Lifecycle of each session after every trigger that touched it, as the batch operator has it.

    ``events`` has a watermark on ``timestamp``.  A session without events for ``idle`` beyond the
    watermark is forgotten.  The state keys are ``buckets`` of sessions, a number that stays for the life of a checkpoint.
    """

    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return (
        events.select("session_id", "type", "revision_id", "timestamp", "seq")
        .withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandasWithState(
            _session(idle_ms), SESSION_ROWS, SESSION_STATE, "update", GroupStateTimeout.EventTimeTimeout
        )
    )


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything available and return what it wrote, as a table."""

    spark = stream.sparkSession
    root = f"{run_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{root}/out"

    def save(batch: DataFrame, number: int) -> None:
        # The folder of a batch is replaced as a whole, so a repeated batch counts once.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(save).outputMode(mode)
        .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(out)
