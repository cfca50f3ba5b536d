"""Session logs (one JSON object a line) as canonical frames.

Files are found and read by Spark, one row a file, and exploded into numbered
lines; each line is parsed into a VARIANT, so unknown fields and malformed lines
cost nothing and no schema is inferred.  A format is a function from lines to
*entries*: messages with a list of uniform blocks.  What all formats share
(joining texts, numbering calls, session rollups, classification) happens once
on the union of the entries.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..frames import MESSAGES, SESSIONS, TOOL_CALLS, TOOL_RESULTS, Frames, conform
from ..operators.ordered import numbered
from ..plans.classify import classify_frames

# Where the tools keep their logs, and how their paths tell them apart, most specific first.
DEFAULT_ROOTS = (".claude/projects", ".codex/sessions", ".gemini/history", "openclaw-sessions")
PATH_HINTS = ((".claude", "ClaudeCode"), (".codex", "CodexCli"), (".gemini", "GeminiCli"), ("openclaw", "OpenClaw"), (".pi/agent/sessions", "PiCodingAgent"))
DISPLAY = {"ClaudeCode": "Claude Code", "CodexCli": "Codex CLI", "GeminiCli": "Gemini CLI", "OpenClaw": "OpenClaw", "PiCodingAgent": "Pi Coding Agent"}
# Fixed value: from this time on, thinking that is absent was redacted.
REDACTED_FROM = "2026-02-12T00:00:00Z"

BLOCK = "array<struct<kind:string,text:string,id:string,name:string,input:string,is_error:boolean>>"


def discover(home: str | None = None) -> list[str]:
    """Default log folders that exist."""
    home = home or os.path.expanduser("~")
    return [p for p in (os.path.join(home, r) for r in DEFAULT_ROOTS) if os.path.isdir(p)]


def roots_below(path: str) -> list[str]:
    """A local folder and the hidden ones inside it, which Spark's listing would pass over; other paths as they are.

    A local path that does not exist gives nothing.
    """
    if "://" in path or os.path.isfile(path):
        return [path]
    hidden = [os.path.join(d, x) for d, names, _ in os.walk(path, followlinks=True) for x in names if x[0] in "._"]
    return [path, *hidden] if os.path.isdir(path) else []


def empty_files(paths: list[str]) -> list[str]:
    """Log files without a byte in local folders: Spark's file sources pass over them."""
    walked = ((d, n) for p in paths if "://" not in p for d, _, names in os.walk(p, followlinks=True) for n in names)
    return sorted({os.path.join(d, n) for d, n in walked if n.endswith(".jsonl") and os.path.getsize(os.path.join(d, n)) == 0})


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, content`` of every ``*.jsonl`` below the paths; a missing path has none."""
    paths = [r for p in ([paths] if isinstance(paths, str) else paths) for r in roots_below(p)]
    if not paths:
        return spark.createDataFrame([], "path string, content string")
    rows = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.jsonl").select(F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^file:/+", "/").alias("path"), F.col("value").alias("content"))
    return rows


def read_lines(files: DataFrame) -> DataFrame:
    """``path, line_no, v``: the lines that are JSON objects, parsed."""
    lines = files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line")).where("trim(line) <> ''")
    return lines.select("path", "line_no", F.try_parse_json("line").alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")


def get(v: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def has(v: Column, key: str) -> Column:
    return get(v, f"$.{key}", "variant").isNotNull()


def timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text)


# --- which tool wrote a file ---


def tool_of_path(path: Column) -> Column:
    out = F
    for hint, tool in PATH_HINTS:
        out = out.when(F.contains(path, F.lit(hint)), tool)
    return out


def tool_of_line(v: Column) -> Column:
    """The tool that a file's first line gives away, if it does."""
    kind, model = get(v, "$.type"), get(v, "$.model")
    return (
        F.when(has(v, "parentUuid") | has(v, "parentMessageUuid") | kind.isin("summary", "human", "assistant"), "ClaudeCode")
        .when(has(v, "id") & model.rlike("^(gpt|o1|o3|o4)|codex"), "CodexCli")
        .when(has(v, "gemini") | has(v, "generationConfig"), "GeminiCli")
        .when(has(v, "openclaw"), "OpenClaw")
        .when((kind == "session") & get(v, "$.id").isNotNull() & get(v, "$.cwd").isNotNull() & get(v, "$.version", "bigint").isNotNull(), "PiCodingAgent")
    )


def detect(lines: DataFrame) -> DataFrame:
    """``path, tool``: by path, else by the first line, else by the first parser that knows some line."""
    kind = get("v", "$.type")
    votes = lines.groupBy("path").agg(
        F.min_by(tool_of_line(F.col("v")), "line_no").alias("first"),
        F.bool_or(kind.isin("user", "assistant") & has(F.col("v"), "message")).alias("claude"),
        F.bool_or(kind.isin("session_meta", "response_item", "turn_context")).alias("codex"),
        F.bool_or(kind == "session").alias("pi"),
    )
    known = F.when(F.col("claude"), "ClaudeCode").when(F.col("codex"), "CodexCli").when(F.col("pi"), "PiCodingAgent")
    return votes.select("path", F.coalesce(tool_of_path(F.col("path")), F.col("first"), known).alias("tool")).where("tool is not null")


# --- blocks ---


def block(kind, text=None, id_=None, name=None, input_=None, error=None) -> Column:
    lit = lambda x, t: (F.lit(None) if x is None else x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(
        lit(kind, "string").alias("kind"), lit(text, "string").alias("text"), lit(id_, "string").alias("id"), lit(name, "string").alias("name"),
        lit(input_, "string").alias("input"), F.coalesce(lit(error, "boolean"), F.lit(False)).alias("is_error"),
    )


def as_text(v: Column) -> Column:
    """A string as it is, anything else as JSON."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v), F.lit("null"))


def blocks_of(content: Column, of_block) -> Column:
    """A string as one text block, a list through ``of_block``."""
    many = F.try_variant_get(content, "$", "array<variant>")
    one = F.when(F.schema_of_variant(content) == "STRING", F.array(block("text", F.try_variant_get(content, "$", "string"))))
    return F.coalesce(F.filter(F.transform(many, lambda b: of_block(b)), lambda b: b["kind"].isNotNull()), one, F.array().cast(BLOCK))


def common_block(b: Column, claude_user: Column | None = None) -> Column:
    """Text, thinking, tool use and tool result as most formats spell them."""
    kind = get(b, "$.type")
    result = kind == "tool_result"
    if claude_user is not None:
        result = result | (claude_user & ~F.coalesce(kind, F.lit("")).isin("text", "thinking", "tool_use") & get(b, "$.tool_use_id").isNotNull())
    return (
        F.when((kind.isin("text", "input_text", "output_text")) & get(b, "$.text").isNotNull(), block("text", get(b, "$.text")))
        .when((kind == "thinking") & get(b, "$.thinking").isNotNull(), block("thinking", get(b, "$.thinking")))
        .when(kind == "tool_use", block("tool_use", None, F.coalesce(get(b, "$.id"), F.lit("")), F.coalesce(get(b, "$.name"), F.lit("")), as_text(get(b, "$.input", "variant"))))
        .when(result, block("tool_result", as_text(get(b, "$.content", "variant")), F.coalesce(get(b, "$.tool_use_id"), F.lit("")), None, None, get(b, "$.is_error", "boolean")))
        .otherwise(block("unknown"))
    )


ENTRY = ("path", "line_no", "role", "ts", "blocks")


def claude_entries(lines: DataFrame) -> DataFrame:
    kind = get("v", "$.type")
    user = kind == "user"
    rows = lines.where(kind.isin("user", "assistant") & has(F.col("v"), "message"))
    return rows.select("path", "line_no", F.when(user, "User").otherwise("Assistant").alias("role"), timestamp(get("v", "$.timestamp")).alias("ts"), blocks_of(get("v", "$.message.content", "variant"), lambda b: common_block(b, user)).alias("blocks"))


@F.pandas_udf(StructType([StructField("raw", StringType()), StructField("shown", StringType())]))
def reasoning_summary(summary: pd.Series, signature: pd.Series) -> pd.DataFrame:
    """Text fields below a summary and a signature's summary, in document order; ``shown`` without repetitions."""

    def texts(value):
        if isinstance(value, str):
            yield value
        elif isinstance(value, list):
            for x in value:
                yield from texts(x)
        elif isinstance(value, dict):
            for k, x in value.items():
                if k == "text" and isinstance(x, str):
                    yield x
                elif isinstance(x, (list, dict)):
                    yield from texts(x)

    out = []
    for s, g in zip(summary, signature, strict=True):
        found = [] if s is None else list(texts(json.loads(s)))
        inner = None if g is None else json.loads(g)
        if isinstance(inner, dict) and "summary" in inner:
            found += texts(inner["summary"])
        found = [t for t in found if t.strip()]
        out.append(("\n".join(found), "\n".join(dict.fromkeys(found))) if found else (None, None))
    return pd.DataFrame(out, columns=["raw", "shown"])


def codex_entries(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries, and the paths of files that break the format's rules and are rejected whole."""
    item, payload = get("v", "$.payload.type"), get("v", "$.payload", "variant")
    rows = lines.where(get("v", "$.type") == "response_item")
    messages = rows.where(item == "message")
    named = F.when(get(payload, "$.role") == "user", "User").when(get(payload, "$.role") == "assistant", "Assistant").otherwise("System")
    each = messages.select(
        "path", "line_no", named.alias("role"), timestamp(get("v", "$.timestamp")).alias("ts"),
        F.posexplode_outer(get(payload, "$.content", "array<variant>")).alias("block_no", "b"),
    )
    thinks = each.where(get("b", "$.type") == "thinking")
    thinks = thinks.withColumn("s", reasoning_summary(F.to_json(get("b", "$.summary", "variant")), F.to_json(get("b", "$.thinkingSignature", "variant"))))
    plain = F.nullif(F.trim(F.coalesce(get("b", "$.thinking"), F.lit(""))), F.lit(""))
    signed, shown, raw = get("b", "$.thinkingSignature", "variant").isNotNull(), F.col("s.shown"), F.col("s.raw")
    clash = plain.isNotNull() & ((shown.isNotNull() & (plain != F.trim(raw)) & (plain != F.trim(shown))) | (shown.isNull() & signed))
    thought = (
        F.when(signed & shown.isNotNull(), block("summary", shown)).when(signed, block("signature"))
        .when(plain.isNotNull(), block("thinking", get("b", "$.thinking"))).when(shown.isNotNull(), block("summary", shown))
    )
    bad = rows.where(item == "reasoning").select("path").unionByName(thinks.where(clash).select("path")).distinct()
    others = each.where(F.coalesce(get("b", "$.type"), F.lit("")) != "thinking")
    both = thinks.select("path", "line_no", "role", "ts", "block_no", thought.alias("block")).unionByName(others.select("path", "line_no", "role", "ts", "block_no", F.when(F.col("b").isNotNull(), common_block(F.col("b"))).alias("block")))
    ordered = F.array_sort(F.filter(F.collect_list(F.struct("block_no", "block")), lambda x: x["block"].isNotNull()))
    entries = both.groupBy("path", "line_no", "role", "ts").agg(F.transform(ordered, lambda x: x["block"]).alias("blocks"))
    return entries.join(bad, "path", "left_anti"), bad


def openclaw_entries(lines: DataFrame) -> DataFrame:
    role = get("v", "$.message.role")
    rows = lines.where((get("v", "$.type") == "message") & has(F.col("v"), "message"))
    named = F.when(role == "user", "User").when(role == "assistant", "Assistant").otherwise("System")
    return rows.select("path", "line_no", named.alias("role"), timestamp(get("v", "$.timestamp")).alias("ts"), blocks_of(get("v", "$.message.content", "variant"), common_block).alias("blocks"))


def _pi_block(b: Column) -> Column:
    kind = get(b, "$.type")
    thinking = F.coalesce(get(b, "$.thinking"), F.lit(""))
    visible = (F.trim(thinking) != "") & ~F.coalesce(get(b, "$.redacted", "boolean"), F.lit(False))
    return (
        F.when(kind == "text", block("text", F.coalesce(get(b, "$.text"), F.lit(""))))
        .when((kind == "thinking") & visible, block("thinking", thinking))
        .when((kind == "thinking") & get(b, "$.thinkingSignature").isNotNull(), block("signature"))
        .when(kind == "thinking", block(None))
        .when(kind == "toolCall", block("tool_use", None, F.coalesce(get(b, "$.id"), F.lit("")), F.coalesce(get(b, "$.name"), F.lit("")), as_text(get(b, "$.arguments", "variant"))))
        .otherwise(block("unknown"))
    )


def pi_entries(lines: DataFrame) -> DataFrame:
    kind, role, content = get("v", "$.type"), get("v", "$.message.role"), get("v", "$.message.content", "variant")
    rows = lines.where(((kind == "message") & has(F.col("v"), "message")) | (kind.isin("compaction", "branch_summary") & get("v", "$.summary").isNotNull()))
    joined = F.array_join(F.transform(F.filter(F.try_variant_get(content, "$", "array<variant>"), lambda b: get(b, "$.text").isNotNull()), lambda b: get(b, "$.text")), "\n")
    text = F.coalesce(F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")), joined, F.lit(""))
    command, output = F.coalesce(get("v", "$.message.command"), F.lit("")), F.coalesce(get("v", "$.message.output"), F.lit(""))
    blocks = (
        F.when(kind != "message", F.array(block("text", get("v", "$.summary"))))
        .when(role == "toolResult", F.array(block("tool_result", text, F.coalesce(get("v", "$.message.toolCallId"), F.lit("")), None, None, get("v", "$.message.isError", "boolean")), block("text", text)))
        .when(role == "bashExecution", F.array(block("text", F.when(command == "", output).otherwise(F.concat(F.lit("$ "), command, F.lit("\n"), output)))))
        .otherwise(blocks_of(content, _pi_block))
    )
    named = F.when(role == "user", "User").when(role == "assistant", "Assistant").otherwise("System")
    return rows.select("path", "line_no", named.alias("role"), timestamp(get("v", "$.timestamp")).alias("ts"), blocks.alias("blocks"))


# --- sessions ---


def _first(value: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col("line_no")))


def _last(value: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col("line_no")))


def session_facts(lines: DataFrame) -> DataFrame:
    """One row a file with what its envelope lines say; ``lines`` has ``tool``."""
    kind = get("v", "$.type")
    claude, codex = F.col("tool") == "ClaudeCode", F.col("tool") == "CodexCli"
    payload = get("v", "$.payload", "variant")
    meta, context = codex & (kind == "session_meta"), codex & (kind == "turn_context")
    envelope = ~claude & ~codex & (kind == "session")
    snapshot = (kind == "custom") & (get("v", "$.customType") == "model-snapshot")
    model = F.coalesce(
        F.when(kind == "model_change", get("v", "$.modelId")), F.when(snapshot, get("v", "$.data.modelId")),
        F.when((kind == "message") & (get("v", "$.message.role") == "assistant"), get("v", "$.message.model")),
    )
    provider = F.coalesce(
        F.when(kind == "model_change", get("v", "$.provider")), F.when(snapshot, get("v", "$.data.provider")),
        F.when((kind == "message") & (get("v", "$.message.role") == "assistant"), get("v", "$.message.provider")),
    )
    when = lambda cond, path, v="v": F.when(cond, get(v, path))
    own = lambda path: _first(when(claude, path))
    return lines.groupBy("path", "tool").agg(
        F.coalesce(own("$.sessionId"), _last(F.when(meta, get(payload, "$.id"))), _last(when(envelope, "$.id"))).alias("session_id"),
        F.coalesce(own("$.version"), _last(F.when(meta, get(payload, "$.cli_version")))).alias("version"),
        F.coalesce(own("$.cwd"), _last(F.when(meta, get(payload, "$.cwd"))), _last(when(envelope, "$.cwd"))).alias("cwd"),
        F.coalesce(own("$.gitBranch"), _last(F.when(meta, get(payload, "$.git.branch")))).alias("git_branch"),
        F.coalesce(own("$.permissionMode"), _last(F.when(context, get(payload, "$.approval_policy")))).alias("permission_mode"),
        F.coalesce(_first(when(claude & (kind == "assistant"), "$.message.model")), _last(F.when(context, get(payload, "$.model"))), _last(F.when(~claude & ~codex, model))).alias("model"),
        F.coalesce(F.bool_or(claude & (get("v", "$.agentId").isNotNull() | F.coalesce(get("v", "$.isSidechain", "boolean"), F.lit(False)))), F.lit(False)).alias("sidechain"),
        _last(F.when(~claude & ~codex, provider)).alias("provider"),
        _last(when(~claude & ~codex & (kind == "thinking_level_change"), "$.thinkingLevel")).alias("thinking_level"),
        _last(F.when(meta, get(payload, "$.model_provider"))).alias("model_provider"),
        _last(F.when(meta, get(payload, "$.git.commit_hash"))).alias("git_commit"),
        _last(F.when(meta, get(payload, "$.git.repository_url"))).alias("git_repo"),
        _last(F.when(context, get(payload, "$.effort"))).alias("effort"),
        _last(F.when(context, get(payload, "$.personality"))).alias("personality"),
        _last(F.when(context, get(payload, "$.sandbox_policy.type"))).alias("sandbox_policy"),
        _last(when(envelope, "$.version")).alias("format_version"),
        _last(F.when(envelope, as_text(get("v", "$.parentSession", "variant")))).alias("parent_session"),
        F.bool_or((get("v", "$.message.api") == "openai-responses") & (get("v", "$.message.provider") == "openclaw") & (get("v", "$.message.model") == "delivery-mirror")).alias("uses_delivery_mirror"),
    )


OBSERVABILITY = ("Absent", "SignatureOnly", "SummaryVisible", "FullTextVisible", "Unknown")


def observability(blocks: Column, unknown_counts: Column) -> Column:
    """The strongest mode among a message's blocks: unknown above full text, summary and signature."""
    any_of = lambda k: F.exists(blocks, lambda b: b["kind"] == k)
    return F.when(unknown_counts & any_of("unknown"), "Unknown").when(any_of("thinking"), "FullTextVisible").when(any_of("summary"), "SummaryVisible").when(any_of("signature"), "SignatureOnly").otherwise("Absent")


def environment(messages: DataFrame) -> DataFrame:
    """Servers, plugins and hooks that user texts mention, each once, in order."""
    lines = messages.where("role = 'User' and text <> ''").select("session_key", "msg_idx", F.posexplode(F.split("text", "\r?\n")).alias("i", "raw"))
    lines = lines.withColumn("t", F.trim("raw"))
    heading = F.when(F.col("t").rlike("^## (plugin|mcp):"), F.array(F.regexp_replace("t", "^(## )+", "")))
    words = F.transform(F.regexp_extract_all("t", F.lit(r"(?:^|(?<=\s))mcp__(\S*)"), 1), lambda w: F.replace(F.element_at(F.split(w, "__"), 1), F.lit("_"), F.lit(":")))
    hook = F.when(F.contains("t", F.lit("PreToolUse")), "PreToolUse").when(F.contains("t", F.lit("PostToolUse")), "PostToolUse").when(F.col("t").rlike("hook_progress|hookEvent"), "unknown")
    ordered = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", "i", c.alias("x")))), lambda r: r["x"])))
    servers = F.concat(F.coalesce(heading, F.array().cast("array<string>")), words)
    return lines.groupBy("session_key").agg(ordered(servers).alias("mcp_servers"), ordered(F.array_compact(F.array(hook))).alias("hooks"))


@dataclass(frozen=True)
class ReadResult:
    frames: Frames
    rejected: DataFrame  # path, of files with contradictory reasoning blocks
    unknown: DataFrame  # path, of files no format claims


SOURCES = {"ClaudeCode": claude_entries, "CodexCli": codex_entries, "OpenClaw": openclaw_entries, "PiCodingAgent": pi_entries}


def parse_logs(files: DataFrame) -> ReadResult:
    """Canonical, classified frames over ``path, content``."""
    lines = read_lines(files)
    tools = detect(lines)
    lines = lines.join(tools, "path")
    of = lambda tool: lines.where(F.col("tool") == tool).drop("tool")
    codex, rejected = codex_entries(of("CodexCli"))
    entries = claude_entries(of("ClaudeCode"))
    for more in (codex, openclaw_entries(of("OpenClaw")), pi_entries(of("PiCodingAgent"))):
        entries = entries.unionByName(more.select(*ENTRY))
    entries = entries.join(tools, "path")

    pick = lambda k, column="text": F.array_join(F.transform(F.filter("blocks", lambda b: b["kind"] == k), lambda b: b[column]), "\n")
    some = lambda k: F.exists("blocks", lambda b: b["kind"] == k)
    order = W.partitionBy("path").orderBy("line_no")
    rows = entries.select(
        F.col("path").alias("session_key"), "tool", (F.row_number().over(order) - 1).alias("msg_idx"), "role", "ts", "blocks", pick("text").alias("text"),
        F.when(some("thinking"), pick("thinking")).alias("thinking"), F.when(some("summary"), pick("summary")).alias("reasoning_summary"),
        observability(F.col("blocks"), F.col("tool") == "CodexCli").alias("reasoning_observability"), some("tool_result").alias("has_tool_result"),
        F.size(F.filter("blocks", lambda b: b["kind"] == "tool_use")).alias("n_tool_calls"), F.lit("Unclassified").alias("classification"),
    )
    calls = rows.select("session_key", "msg_idx", F.posexplode(F.filter("blocks", lambda b: b["kind"] == "tool_use")).alias("call_idx", "b"))
    calls = calls.select("session_key", "msg_idx", "call_idx", F.row_number().over(W.partitionBy("session_key").orderBy("msg_idx", "call_idx")).alias("pos"), F.col("b.id").alias("call_id"), "b.name", "b.input")
    results = rows.select("session_key", "msg_idx", F.posexplode(F.filter("blocks", lambda b: b["kind"] == "tool_result")).alias("res_idx", "b"))
    results = results.select("session_key", "msg_idx", "res_idx", F.col("b.id").alias("tool_use_id"), F.col("b.text").alias("content"), "b.is_error")

    modes = rows.groupBy("session_key").agg(
        F.bool_or(F.col("thinking").isNotNull()).alias("thinks"), F.min("ts").alias("first_ts"), F.bool_or(F.col("role") == "User").alias("users"),
        F.count_if(F.col("role") == "User").alias("n_users"), F.bool_or((F.col("role") == "User") & (F.trim("text") != "")).alias("real_text"),
        F.collect_set(F.when(~F.col("reasoning_observability").isin("Absent", "Unknown"), F.col("reasoning_observability"))).alias("modes"),
        F.bool_or(F.col("reasoning_observability") == "Unknown").alias("some_unknown"), F.min_by("text", F.when(F.col("role") == "User", F.col("msg_idx"))).alias("first_user_text"),
    )
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    facts = session_facts(lines).join(modes.withColumnRenamed("session_key", "path"), "path")
    claude = F.col("tool") == "ClaudeCode"
    agent = F.when((F.col("tool") == "OpenClaw") & (stem != "main"), stem)
    subagent = (
        F.when(claude, F.col("path").rlike("/subagents/") | F.col("sidechain") | ~F.coalesce("real_text", F.lit(False)))
        .when(F.col("tool") == "CodexCli", (F.coalesce("permission_mode", F.lit("")) == "never") & (F.col("n_users") <= 1))
        .otherwise(agent.isNotNull())
    )
    kind = F.when(subagent, "Subagent").when(claude | F.col("users"), "Interactive").otherwise("Unknown")
    late = F.col("first_ts") >= F.to_timestamp(F.lit(REDACTED_FROM))
    visible = F.when(F.col("tool") == "CodexCli", "Unknown").when(F.col("thinks"), "Visible").when(claude & ~late, "Visible").when(claude & late, "Redacted").otherwise("Unknown")
    session_mode = F.when(F.size("modes") > 1, "Mixed").when(F.col("some_unknown"), "Unknown").when(F.size("modes") == 1, F.get("modes", F.lit(0))).otherwise("Absent")
    fenced = lambda marker: F.regexp_extract("first_user_text", marker + r"[\s\S]*?```json\r?\n([\s\S]*?)```", 1)
    claw = F.col("tool") == "OpenClaw"
    more = {
        **{c: F.col(c) for c in ("provider", "thinking_level", "model_provider", "git_commit", "git_repo", "effort", "personality", "sandbox_policy", "format_version")},
        "parent_session": F.nullif("parent_session", F.lit("null")), "agent_name": agent, "uses_delivery_mirror": F.when(claw & F.col("uses_delivery_mirror"), "true"),
        "conversation_label": F.when(claw, get(F.try_parse_json(fenced(r"Conversation info \(untrusted metadata\):")), "$.conversation_label")),
        "first_sender": F.when(claw, F.to_json(F.try_parse_json(fenced(r"Sender \(untrusted metadata\):")))),
    }
    extra = F.map_filter(F.create_map(*(x for k, v in more.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    sessions = facts.select(
        F.col("path").alias("session_key"), F.coalesce("session_id", F.nullif(stem, F.lit("")), F.lit("unknown")).alias("session_id"), F.col("path").alias("source_path"),
        F.col("tool").alias("source_tool"), kind.alias("session_type"), visible.alias("thinking_visibility"), session_mode.alias("reasoning_observability"),
        F.when(claude, F.regexp_extract("path", "([^/]*)/[^/]*$", 1)).alias("project"), "cwd", "git_branch", "model", "version", "permission_mode", extra.alias("extra"), "first_ts",
    )
    sessions = sessions.join(environment(rows.where("tool = 'ClaudeCode'")), "session_key", "left")
    sessions = numbered(sessions, "source_path", ["source_path"], "session_ord", like=files.select(F.col("path").alias("source_path")))
    frames = Frames(conform(sessions, SESSIONS), conform(rows, MESSAGES), conform(calls, TOOL_CALLS), conform(results, TOOL_RESULTS))
    unknown = files.where(F.trim("content") != "").select("path").join(tools, "path", "left_anti")
    return ReadResult(classify_frames(frames), rejected, unknown)


def read_logs(spark: SparkSession, paths: str | list[str]) -> ReadResult:
    """Read, detect, parse and classify every log below the paths."""
    return parse_logs(read_files(spark, paths))


def parse_dump(spark: SparkSession, path: str, pretty: bool = False) -> str:
    """One file's sessions as JSON text, with their messages."""
    frames = read_logs(spark, path).frames
    messages = frames.messages.groupBy("session_key").agg(F.array_sort(F.collect_list(F.struct("msg_idx", "role", "ts", "text", "thinking", "classification"))).alias("messages"))
    rows = [json.loads(r) for r in frames.sessions.join(messages, "session_key").toJSON().collect()]
    return json.dumps(rows, indent=2 if pretty else None, ensure_ascii=False)


# --- trace tables ---


def trace_entries(rows: DataFrame) -> DataFrame:
    """Messages of trace rows ``timestamp, request_id, conversation_json``: the request's, then the response."""
    v = F.try_parse_json("conversation_json")
    asked = F.transform(F.coalesce(F.try_variant_get(v, "$.request.messages", "array<variant>"), F.array().cast("array<variant>")), lambda m: F.struct(get(m, "$.role").alias("role"), as_text(get(m, "$.content", "variant")).alias("text")))
    asked = F.filter(asked, lambda m: m["role"].isin("user", "assistant"))
    answer = F.when(get(v, "$.response.content", "variant").isNotNull(), F.array(F.struct(F.lit("assistant").alias("role"), as_text(get(v, "$.response.content", "variant")).alias("text"))))
    number = F.try_variant_get(v, "$.request.timestamp", "double")
    number = F.coalesce(number, F.col("timestamp").try_cast("double"))
    ts = F.coalesce(F.timestamp_seconds(F.when(number > 1e10, number / 1000).otherwise(number)), timestamp(F.col("timestamp")))
    each = rows.select("request_id", ts.alias("ts"), F.posexplode(F.concat(asked, F.coalesce(answer, F.slice(asked, 1, 0)))).alias("msg_idx", "m"))
    return each.select(F.col("request_id").alias("session_key"), "msg_idx", F.initcap("m.role").alias("role"), "ts", "m.text")
