"""The four canonical frames that every technique reads.

``sessions`` has one row a session, ``messages`` one a message, ``tool_calls`` one
a call and ``tool_results`` one a result.  Spark rows have no order, so order is
data: ``msg_idx`` in a session, ``call_idx`` in a message, ``pos`` in the whole
tool sequence of a session (from 1) and ``session_ord`` among sessions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SESSIONS = (
    "session_key string, session_ord bigint, session_id string, source_path string, source_tool string, session_type string, "
    "thinking_visibility string, reasoning_observability string, project string, cwd string, git_branch string, model string, "
    "version string, permission_mode string, extra map<string,string>, mcp_servers array<string>, plugins array<string>, hooks array<string>"
)
MESSAGES = (
    "session_key string, msg_idx int, role string, ts timestamp, text string, thinking string, reasoning_summary string, "
    "reasoning_observability string, classification string, has_tool_result boolean, n_tool_calls int"
)
TOOL_CALLS = "session_key string, msg_idx int, call_idx int, pos bigint, call_id string, name string, input string"
TOOL_RESULTS = "session_key string, msg_idx int, res_idx int, tool_use_id string, content string, is_error boolean"


@dataclass(frozen=True)
class Frames:
    sessions: DataFrame
    messages: DataFrame
    tool_calls: DataFrame
    tool_results: DataFrame

    def persist(self) -> Frames:
        """Keep the frames for a run of several techniques (disk where memory is short)."""
        for df in (self.sessions, self.messages, self.tool_calls, self.tool_results):
            df.persist()
        return self

    def stratum(self, session_type: str) -> Frames:
        """The frames restricted to the sessions of one type."""
        sessions = self.sessions.where(F.col("session_type") == session_type)
        keys = sessions.select("session_key")
        semi = lambda df: df.join(keys, "session_key", "left_semi")
        return Frames(sessions, semi(self.messages), semi(self.tool_calls), semi(self.tool_results))

    def with_messages(self, messages: DataFrame) -> Frames:
        return replace(self, messages=messages)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Exactly the columns of ``schema``, missing ones as null."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def events_frames(events: DataFrame, projects: int = 7) -> Frames:
    """Frames over a table of ``event_id, ts, user_id, event_type, value``.

    A user's events are one autonomous session in order of time and id; each
    event is an assistant message with one tool call named by its type, and an
    ``error`` event is a failed result.  ``project`` is a surrogate, the user id
    modulo ``projects``.
    """
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.select(
        F.col("user_id").cast("string").alias("session_key"),
        F.col("user_id").alias("user_id"),
        F.row_number().over(order).cast("bigint").alias("pos"),
        "ts",
        F.col("event_id").cast("string").alias("call_id"),
        F.col("event_type").alias("name"),
        F.col("value"),
    )
    rows = rows.withColumn("msg_idx", (F.col("pos") - 1).cast("int"))
    sessions = rows.groupBy("session_key", "user_id").agg(F.lit(1).alias("n")).select(
        "session_key", F.col("user_id").alias("session_ord"), F.col("session_key").alias("session_id"), F.lit("events").alias("source_tool"),
        F.lit("Autonomous").alias("session_type"), F.lit("Unknown").alias("thinking_visibility"),
        F.concat(F.lit("p"), F.col("user_id") % projects).alias("project"),
    )
    messages = rows.select("session_key", "msg_idx", F.lit("Assistant").alias("role"), "ts", F.lit("").alias("text"), F.lit("Other").alias("classification"), F.lit(False).alias("has_tool_result"), F.lit(1).alias("n_tool_calls"))
    calls = rows.select("session_key", "msg_idx", F.lit(0).alias("call_idx"), "pos", "call_id", "name", F.to_json(F.struct("value")).alias("input"))
    results = rows.select("session_key", "msg_idx", F.lit(0).alias("res_idx"), F.col("call_id").alias("tool_use_id"), F.lit("").alias("content"), (F.col("name") == "error").alias("is_error"))
    return Frames(conform(sessions, SESSIONS), conform(messages, MESSAGES), conform(calls, TOOL_CALLS), conform(results, TOOL_RESULTS))


def conversation_frames(conversations: DataFrame, projects: int = 7) -> Frames:
    """Frames over a table of ``conv_id, turn, role, text``; messages and sessions are classified."""
    from .plans.classify import classify_frames

    rows = conversations.select(F.col("conv_id").cast("string").alias("session_key"), F.col("conv_id"), F.col("turn").cast("int").alias("msg_idx"), F.initcap("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sessions = rows.groupBy("session_key", "conv_id").agg(F.lit(1).alias("n")).select(
        "session_key", F.col("conv_id").alias("session_ord"), F.col("session_key").alias("session_id"), F.lit("conversations").alias("source_tool"),
        F.lit("Unknown").alias("session_type"), F.lit("Unknown").alias("thinking_visibility"), F.concat(F.lit("p"), F.col("conv_id") % projects).alias("project"),
    )
    messages = rows.withColumn("has_tool_result", F.lit(False)).withColumn("n_tool_calls", F.lit(0))
    none = rows.where("false")
    frames = Frames(conform(sessions, SESSIONS), conform(messages, MESSAGES), conform(none.select("session_key"), TOOL_CALLS), conform(none.select("session_key"), TOOL_RESULTS))
    return classify_frames(frames)
