"""Message and session classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import Frames
from ..functions import patterns as P


def message_class(first: Column) -> Column:
    """Class of a message row; ``first`` says whether it is its session's first user message."""
    text = P.trimmed(F.col("text"))
    low = F.lower(text)
    short = F.octet_length(text) < P.LEXICAL_BYTES
    tagged = F.lit(False)
    for tag in P.SYSTEM_TAGS:
        tagged = tagged | F.contains("text", F.lit(tag))
    return (
        F.when(F.col("role") != "User", "Other")
        .when(F.col("has_tool_result"), "SystemMessage")
        .when(tagged, "SystemMessage")
        .when(short & low.rlike(P.bounded(P.CORRECTIONS)), "HumanCorrection")
        .when(short & low.rlike(P.bounded(P.APPROVALS)), "HumanApproval")
        .when(short & (F.contains(text, F.lit("?")) | low.rlike(P.starts(P.QUESTION_STARTS))), "HumanQuestion")
        .when(first | short, "HumanDirective")
        .otherwise("Other")
    )


def classify_frames(frames: Frames) -> Frames:
    """Fill ``classification`` of messages and ``session_type`` of sessions.

    A session that its parser knows as ``Subagent`` stays that.  Tool results in
    user messages also make one, as every log with tools has them there.
    """
    users = W.partitionBy("session_key", F.col("role") == "User").orderBy("msg_idx")
    numbered = frames.messages.withColumn("classification", message_class(F.row_number().over(users) == 1))
    user = F.col("role") == "User"
    facts = numbered.groupBy("session_key").agg(
        F.bool_or(user & F.col("has_tool_result")).alias("results"),
        F.bool_or(user & F.startswith("classification", F.lit("Human"))).alias("human"),
        F.bool_or(user).alias("users"),
    )
    path = F.lower(F.coalesce("source_path", F.lit("")))
    subagent = (F.col("session_type") == "Subagent") | path.contains("subagent") | path.contains("agent-a")
    kind = (
        F.when(F.coalesce(subagent, F.lit(False)) | F.coalesce("results", F.lit(False)), "Subagent")
        .when(F.col("human"), "Interactive")
        .when(F.col("users"), "Autonomous")
        .otherwise("Unknown")
    )
    sessions = frames.sessions.join(facts, "session_key", "left").withColumn("session_type", kind).select(frames.sessions.columns)
    return Frames(sessions, numbered.select(frames.messages.columns), frames.tool_calls, frames.tool_results)
