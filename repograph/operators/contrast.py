"""Agent run transcripts: traces of single runs and their side-by-side figures.

``lines`` has (run_id, side, line_no, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repograph import constants as K

RUN = ["run_id", "side"]
NO_LIMIT = 2**31 - 1
# The fields that may say what a tool call was pointed at, in order.
DETAIL_FIELDS = ["file_path", "pattern", "question", "symbol", "query", "command", "path"]


def read_lines(lines: DataFrame, max_events: int | None = None, max_line: int | None = None) -> DataFrame:
    """Parsed events (run_id, side, line_no, event as VARIANT) of each transcript.

    Blank and non-JSON lines are dropped.  With limits, a line that is too long ends the run, and so does
    the event after the last one allowed; :func:`truncated_runs` says which runs that were.
    """

    full = lines.where(F.trim("line") != "")
    if max_line is None and max_events is None:
        return full.select(*RUN, "line_no", F.try_parse_json("line").alias("event")).where(
            F.col("event").isNotNull())
    max_line, max_events = max_line or NO_LIMIT, max_events or NO_LIMIT
    stop = full.groupBy(*RUN).agg(
        F.min(F.when(F.length("line") > max_line, F.col("line_no"))).alias("stop"))
    order = Window.partitionBy(*RUN).orderBy("line_no")
    kept = (
        full.join(stop, RUN).where(F.col("stop").isNull() | (F.col("line_no") < F.col("stop")))
        .withColumn("event_no", F.row_number().over(order)).where(F.col("event_no") <= max_events)
    )
    return kept.select(*RUN, "line_no", F.try_parse_json("line").alias("event")).where(
        F.col("event").isNotNull())


def truncated_runs(lines: DataFrame, max_events: int, max_line: int) -> DataFrame:
    """(run_id, side) of transcripts that the limits of :func:`read_lines` cut."""

    return lines.where(F.trim("line") != "").groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.length("line")).alias("longest")
    ).where((F.col("n") > max_events) | (F.col("longest") > max_line)).select(*RUN)


def _text(path: str, column: str = "event") -> Column:
    return F.try_variant_get(column, path, "string")


def _count(path: str, column: str = "event") -> Column:
    value = F.try_variant_get(column, path, "bigint")
    return F.greatest(F.coalesce(value, F.lit(0)), F.lit(0))


def one_line(value: Column, limit: int | None = None) -> Column:
    plain = F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x1f\x7f]", " ")
    return F.substring(F.trim(F.regexp_replace(plain, r"\s+", " ")), 1, limit or NO_LIMIT)


def tool_calls(events: DataFrame, limit: int | None = None, detail_limit: int | None = None) -> DataFrame:
    """(run_id, side, call_no, name, detail) of all, or the first, tool calls of each run."""

    # Only the listed fields of a call are read out, so file contents never travel.
    block = (
        "ARRAY<STRUCT<type: STRING, name: STRING, input: STRUCT<"
        + ", ".join(f"{f}: STRING" for f in DETAIL_FIELDS) + ">>>"
    )
    blocks = events.where(_text("$.type") == "assistant").select(
        *RUN, "line_no",
        F.posexplode(F.from_json(F.to_json(F.try_variant_get("event", "$.message.content", "variant")), block))
        .alias("block_no", "b"),
    )
    detail = F.coalesce(*[F.nullif(one_line(F.col(f"b.input.{f}"), detail_limit), F.lit("")) for f in DETAIL_FIELDS], F.lit(""))
    order = Window.partitionBy(*RUN).orderBy("line_no", "block_no")
    return (
        blocks.where((F.col("b.type") == "tool_use") & (F.coalesce("b.name", F.lit("")) != ""))
        .select(*RUN, "line_no", "block_no", F.col("b.name").alias("name"), detail.alias("detail"))
        .withColumn("call_no", F.row_number().over(order)).where(F.col("call_no") <= (limit or NO_LIMIT))
        .drop("line_no", "block_no")
    )


def run_traces(events: DataFrame, answer_limit: int | None = None) -> DataFrame:
    """One row per run: status, model, tools, turns, usage, cost, duration, answer, error."""

    kind = _text("$.type")
    init = (kind == "system") & (_text("$.subtype") == "init")
    result = kind == "result"
    assistant = (kind == "assistant") & F.try_variant_get("event", "$.message", "variant").isNotNull()
    failed = F.coalesce(F.try_variant_get("event", "$.is_error", "boolean"), F.lit(False))
    status = (
        F.when(init | assistant, "running")
        .when(result & failed, "failed").when(result, "completed")
    )
    latest = lambda test, value: F.max_by(F.when(test, value), F.when(test & value.isNotNull(), F.col("line_no")))
    duration = F.nullif(_count("$.duration_ms"), F.lit(0))
    usage = F.try_variant_get("event", "$.usage", "variant")
    used = lambda path: F.when(usage.isNotNull(), _count(f"$.usage.{path}"))
    rows = events.groupBy(*RUN).agg(
        F.coalesce(latest(status.isNotNull(), status), F.lit("starting")).alias("status"),
        latest(init, F.nullif(_text("$.model"), F.lit(""))).alias("model"),
        latest(init, F.to_json(F.try_variant_get("event", "$.tools", "variant"))).alias("tools_json"),
        latest(init, F.to_json(F.try_variant_get("event", "$.mcp_servers", "variant"))).alias("servers_json"),
        F.coalesce(latest(result, _count("$.num_turns")), F.lit(0)).alias("turns"),
        latest(result, used("input_tokens")).alias("input_tokens"),
        latest(result, used("output_tokens")).alias("output_tokens"),
        latest(result, used("cache_read_input_tokens")).alias("cache_read_tokens"),
        latest(result, used("cache_creation_input_tokens")).alias("cache_creation_tokens"),
        latest(result, used("output_tokens_details.thinking_tokens")).alias("thinking_tokens"),
        latest(result, F.try_variant_get("event", "$.total_cost_usd", "double")).alias("cost_usd"),
        latest(result, duration).alias("duration_ms"),
        latest(result, F.substring(F.nullif(_text("$.result"), F.lit("")), 1, answer_limit or NO_LIMIT)).alias("answer"),
        latest(result & failed, F.coalesce(F.nullif(_text("$.subtype"), F.lit("")),
                                           F.lit("The agent reported an error."))).alias("error"),
    )
    calls = tool_calls(events)
    counted = calls.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("tool_calls"),
        F.countDistinct(F.when((F.col("name") == "Read") & (F.col("detail") != ""), F.col("detail"))).alias("files_read"),
    )
    joined = rows.join(counted, RUN, "left").fillna(0, ["tool_calls", "files_read"])
    server = F.from_json("servers_json", "ARRAY<STRUCT<name: STRING>>")
    return joined.withColumn("tools", F.from_json("tools_json", "ARRAY<STRING>")).withColumn(
        "servers", F.filter(F.transform(server, lambda s: s["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    ).withColumn("error", F.when(F.col("status") == "failed", F.col("error"))).drop("tools_json", "servers_json")


def contrast(traces: DataFrame, keys: list[str], base: str = "base", other: str = "other") -> DataFrame:
    """(keys, metric_no, label, base, other, difference, other_lower, comparable): eight rows.

    ``keys`` pair two runs.  Difference is other minus base; it is null where a side has no
    figure, and for the duration.  Only two completed runs are comparable.
    """

    total = sum(
        (F.coalesce(c, F.lit(0)) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")),
        start=F.lit(0))
    figures = {
        # Metric labels in display order.
        "Total tokens": total, "Output tokens": F.coalesce("output_tokens", F.lit(0)),
        "Cache read tokens": F.coalesce("cache_read_tokens", F.lit(0)), "Tool calls": F.col("tool_calls"),
        "Files read": F.col("files_read"), "Turns": F.col("turns"), "Cost": F.col("cost_usd"),
        "Duration": F.col("duration_ms"),
    }
    rows = traces.select(*keys, "side", "status", F.posexplode(F.array(*[
        F.struct(F.lit(label).alias("label"), value.cast("double").alias("value")) for label, value in figures.items()
    ])).alias("metric_no", "m"))
    of = lambda side, value: F.max(F.when(F.col("side") == side, value))
    wide = rows.groupBy(*keys, "metric_no", F.col("m.label").alias("label")).agg(
        of(base, F.col("m.value")).alias("base"), of(other, F.col("m.value")).alias("other"),
        (F.count_if((F.col("side") == base) & (F.col("status") == "completed")) > 0).alias("base_done"),
        (F.count_if((F.col("side") == other) & (F.col("status") == "completed")) > 0).alias("other_done"),
    )
    zero = F.lit(0.0)
    return wide.select(
        *keys, "metric_no", "label", "base", "other",
        F.when(F.col("label") != "Duration", F.col("other") - F.col("base")).alias("difference"),
        (F.coalesce("other", zero) < F.coalesce("base", zero)).alias("other_lower"),
        (F.col("base_done") & F.col("other_done")).alias("comparable"),
    )
