"""Queries over session logs, each with the SQL it must equal.

No logs come with the test tables, so each conversation is written as the lines of
one log file, its number modulo 4 choosing among the four formats, and goes through
discovery's path rules, format detection and the parsers as a file would.  The SQL
starts from the conversations themselves.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import conversation_frames, events_frames
from ..functions import patterns as P
from ..sources import corpora, logs
from . import behaviour

def _raw(text: str, **parts) -> Column:
    """JSON text with ``$name`` replaced by columns that are JSON already."""
    return F.concat(*(parts[x[1:]] if x.startswith("$") else F.lit(x) for x in re.split(r"(\$[a-z_]+)", text) if x))


def json_text(column: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(column.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def _number(prefix: str, column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), column.cast("string"), F.lit(suffix))


def log_files(conversations: DataFrame) -> DataFrame:
    """``path, content``: one log file a conversation, and some that no format claims."""
    conv, turn = F.col("conv_id"), F.col("turn")
    form = conv % 4
    path = (
        F.when(form == 0, F.concat(_number("/logs/.claude/projects/proj", conv % 7, "/"), F.when(conv % 5 == 0, "subagents/").otherwise(""), _number("c", conv, ".jsonl")))
        .when(form == 1, _number("/logs/.codex/sessions/c", conv, ".jsonl"))
        .when(form == 2, F.concat(_number("/logs/openclaw/", conv, "/"), F.when(conv % 3 == 0, "main").otherwise("helper"), F.lit(".jsonl")))
        .otherwise(_number("/logs/plain/c", conv, ".jsonl"))
    )
    at = F.concat(F.lit("2026-01-01T00:"), F.lpad(turn.cast("string"), 2, "0"), F.lit(":00Z"))
    text = json_text(F.col("text"))
    mention = F.concat("text", F.when(turn <= 1, F.concat(_number("\n## mcp:files", conv % 3), _number("\nuse mcp__big", turn, "__run now PreToolUse"))).otherwise(""))
    block = lambda kind, t: _raw('{"type":"%s","text":$t}' % kind, t=t)
    stamp = F.concat(F.lit('"'), at, F.lit('"'))
    role = F.concat(F.lit('"'), "role", F.lit('"'))
    odd = turn % 4 == 1

    claude_user = _raw('{"type":"user","sessionId":$s,"cwd":$d,"gitBranch":"b","version":$v,"timestamp":$ts,"message":{"role":"user","content":$t}}', s=_number('"s', conv, '"'), d=_number('"/w/', conv, '"'), v=_number('"2.', conv % 3, '"'), ts=stamp, t=json_text(mention))
    thinking = F.when(odd, _raw('{"type":"thinking","thinking":$t},', t=_number('"th', turn, '"'))).otherwise("")
    use = F.when(odd, _raw(',{"type":"tool_use","id":$i,"name":"Read","input":{"file_path":$p}}', i=_number('"t', turn, '"'), p=_number('"/w/x', turn, '.py"'))).otherwise("")
    claude_agent = _raw('{"type":"assistant","timestamp":$ts,"message":{"role":"assistant","model":$m,"content":[$h$b$u]}}', ts=stamp, m=_number('"m', conv % 2 + conv % 3, '"'), h=thinking, b=block("text", text), u=use)
    claude = F.when(F.col("role") == "user", claude_user).when(F.col("role") == "assistant", claude_agent).otherwise(F.lit("{broken"))

    summary = F.when(odd, _raw('{"type":"thinking","summary":[{"text":$t},{"inner":[{"text":"again"},{"text":$t}]}],"thinkingSignature":{"v":1}},', t=_number('"s', turn, '"'))).otherwise("")
    codex = _raw('{"timestamp":$ts,"type":"response_item","payload":{"type":"message","role":$r,"content":[$h$b]}}', ts=stamp, r=F.when(F.col("role") == "system", F.lit('"developer"')).otherwise(role), h=summary, b=block("input_text", text))
    openclaw = _raw('{"type":"message","timestamp":$ts,"message":{"role":$r,"content":[$b]}}', ts=stamp, r=role, b=block("text", text))
    pi = F.when(F.col("role") == "system", _raw('{"type":"message","timestamp":$ts,"message":{"role":"toolResult","content":[$b],"toolCallId":"k","isError":true}}', ts=stamp, b=block("text", text)))
    pi = pi.when(F.col("role") == "user", _raw('{"type":"message","timestamp":$ts,"message":{"role":"user","content":$t}}', ts=stamp, t=text))
    call = F.when(odd, _raw(',{"type":"toolCall","id":$i,"name":"bash","arguments":{"command":"ls"}}', i=_number('"k', turn, '"'))).otherwise("")
    pi = pi.otherwise(_raw('{"type":"message","timestamp":$ts,"message":{"role":"assistant","model":"big","content":[{"type":"thinking","thinking":"","thinkingSignature":"s"},$b$c]}}', ts=stamp, b=block("text", text), c=call))
    line = F.when(form == 0, claude).when(form == 1, codex).when(form == 2, openclaw).otherwise(pi)

    meta = _raw('{"type":"session_meta","payload":{"id":$i,"cwd":"/c","cli_version":"9","git":{"branch":"main","commit_hash":"abc"}}}\n{"type":"turn_context","payload":{"model":"gpt-5","approval_policy":$p}}\n', i=_number('"x', conv, '"'), p=F.when(conv % 3 == 1, F.lit('"never"')).otherwise(F.lit('"on-request"')))
    head = _raw('{"type":"session","version":3,"id":$i,"cwd":"/o"}\n', i=_number('"o', conv, '"'))
    first = F.when(form == 0, "").when(form == 1, meta).when(form == 2, F.concat(head, F.lit('{"type":"model_change","provider":"p1","modelId":"m1"}\n'))).otherwise(head)
    last = F.when((form == 1) & (conv % 8 == 1), F.lit('\n{"type":"response_item","payload":{"type":"reasoning"}}')).otherwise("")
    rows = conversations.select("conv_id", "turn", path.alias("path"), line.alias("line"), first.alias("first"), last.alias("last"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    files = rows.groupBy("path").agg(F.concat(F.first("first"), body, F.first("last")).alias("content"))
    other = conversations.where("conv_id % 10 = 3").select(_number("/logs/other/c", F.col("conv_id"), ".jsonl").alias("path"), F.lit('{"a":1}').alias("content")).distinct()
    return files.unionByName(other)


def _parsed(spark, d) -> logs.ReadResult:
    return logs.parse_logs(log_files(spark.read.parquet(f"{d}/conversations.parquet")))


LOGS = """c0 as (
  select conv_id, turn, role, text, conv_id % 4 as form, turn % 4 = 1 as odd,
    case conv_id % 4 when 0 then '/logs/.claude/projects/proj' || conv_id % 7 || '/' || case when conv_id % 5 = 0 then 'subagents/' else '' end || 'c' || conv_id || '.jsonl'
      when 1 then '/logs/.codex/sessions/c' || conv_id || '.jsonl'
      when 2 then '/logs/openclaw/' || conv_id || '/' || case when conv_id % 3 = 0 then 'main' else 'helper' end || '.jsonl'
      else '/logs/plain/c' || conv_id || '.jsonl' end as session_key
  from conversations),
msgs as (
  select session_key, conv_id, turn, form, odd, row_number() over (partition by session_key order by turn) - 1 as msg_idx,
    case role when 'user' then 'User' when 'assistant' then 'Assistant' else 'System' end as role,
    text || case when form = 0 and role = 'user' and turn <= 1 then chr(10) || '## mcp:files' || conv_id % 3 || chr(10) || 'use mcp__big' || turn || '__run now PreToolUse' else '' end as text
  from c0 where not (form = 0 and role = 'system') and not (form = 1 and conv_id % 8 = 1)),
facts as (
  select session_key, any_value(conv_id) as conv_id, any_value(form) as form, bool_or(role = 'User') as users, count(*) filter (where role = 'User') as n_users,
    bool_or(role = 'Assistant' and odd) as thought, bool_or(role = 'Assistant') as agents, bool_or(odd) as odds,
    bool_or(role = 'User' and trim(text) <> '') as real from msgs group by session_key)"""

QUERIES = {
    "log_messages": (
        lambda s, d: _parsed(s, d).frames.messages.select("session_key", "msg_idx", "role", F.unix_seconds("ts").alias("ts"), "text", "thinking", "reasoning_summary", "reasoning_observability", "has_tool_result", "n_tool_calls"),
        f"""with {LOGS} select session_key, msg_idx, role, epoch(timestamp '2026-01-01 00:00:00')::bigint + 60 * turn as ts, text,
        case when form = 0 and role = 'Assistant' and odd then 'th' || turn end as thinking,
        case when form = 1 and odd then 's' || turn || chr(10) || 'again' end as reasoning_summary,
        case when form = 0 and role = 'Assistant' and odd then 'FullTextVisible' when form = 1 and odd then 'SummaryVisible' when form = 3 and role = 'Assistant' then 'SignatureOnly' else 'Absent' end as reasoning_observability,
        form = 3 and role = 'System' as has_tool_result, (form in (0, 3) and role = 'Assistant' and odd)::bigint as n_tool_calls from msgs""",
    ),
    "log_tool_calls": (
        lambda s, d: _parsed(s, d).frames.tool_calls,
        f"""with {LOGS} select session_key, msg_idx, 0::bigint as call_idx, row_number() over (partition by session_key order by msg_idx) as pos, case form when 0 then 't' else 'k' end || turn as call_id,
        case form when 0 then 'Read' else 'bash' end as name, case form when 0 then '{{"file_path":"/w/x' || turn || '.py"}}' else '{{"command":"ls"}}' end as input
        from msgs where form in (0, 3) and role = 'Assistant' and odd""",
    ),
    "log_tool_results": (
        lambda s, d: _parsed(s, d).frames.tool_results,
        f"with {LOGS} select session_key, msg_idx, 0::bigint as res_idx, 'k' as tool_use_id, text as content, true as is_error from msgs where form = 3 and role = 'System'",
    ),
    "log_sessions": (
        lambda s, d: _parsed(s, d).frames.sessions.drop("extra", "mcp_servers", "plugins", "hooks", "session_type"),
        f"""with {LOGS}, f as (select *, row_number() over (order by session_key) as session_ord from facts)
        select session_key, session_ord, case form when 0 then case when users then 's' || conv_id else 'c' || conv_id end when 1 then 'x' || conv_id else 'o' || conv_id end as session_id, session_key as source_path,
        ['ClaudeCode', 'CodexCli', 'OpenClaw', 'PiCodingAgent'][form + 1] as source_tool,
        case when form = 0 then 'Visible' else 'Unknown' end as thinking_visibility,
        case when form = 0 and thought then 'FullTextVisible' when form = 1 and odds then 'SummaryVisible' when form = 3 and agents then 'SignatureOnly' else 'Absent' end as reasoning_observability,
        case when form = 0 then case when conv_id % 5 = 0 then 'subagents' else 'proj' || conv_id % 7 end end as project,
        case form when 0 then case when users then '/w/' || conv_id end when 1 then '/c' else '/o' end as cwd, case form when 0 then case when users then 'b' end when 1 then 'main' end as git_branch,
        case form when 0 then case when agents then 'm' || (conv_id % 2 + conv_id % 3) end when 1 then 'gpt-5' when 2 then 'm1' else case when agents then 'big' end end as model,
        case form when 0 then case when users then '2.' || conv_id % 3 end when 1 then '9' end as version,
        case when form = 1 then case when conv_id % 3 = 1 then 'never' else 'on-request' end end as permission_mode from f""",
    ),
    "log_subagents": (
        lambda s, d: _parsed(s, d).frames.sessions.select("session_key", (F.col("session_type") == "Subagent").alias("subagent")),
        f"""with {LOGS} select session_key, case form when 0 then conv_id % 5 = 0 or not real when 1 then conv_id % 3 = 1 and n_users <= 1 when 2 then conv_id % 3 <> 0 else false end as subagent from facts""",
    ),
    "log_extras": (
        lambda s, d: _parsed(s, d).frames.sessions.select("session_key", F.explode("extra").alias("name", "value")),
        f"""with {LOGS} select session_key, name, value from (
        select session_key, unnest(['git_commit']) as name, 'abc' as value from facts where form = 1 union all select session_key, 'provider', 'p1' from facts where form = 2
        union all select session_key, 'format_version', '3' from facts where form >= 2 union all select session_key, 'agent_name', 'helper' from facts where form = 2 and conv_id % 3 <> 0)""",
    ),
    "log_environment": (
        lambda s, d: _parsed(s, d).frames.sessions.select("session_key", F.array_join("mcp_servers", ",").alias("servers"), F.array_join("hooks", ",").alias("hooks")).where("servers <> '' or hooks <> ''"),
        f"""with {LOGS}, e as (select session_key, conv_id, list(turn order by turn) as turns from msgs where form = 0 and role = 'User' and turn <= 1 group by session_key, conv_id)
        select session_key, 'mcp:files' || conv_id % 3 || list_reduce(list_transform(turns, lambda t: ',big' || t), lambda x, y: x || y) as servers, 'PreToolUse' as hooks from e""",
    ),
    "log_rejected": (
        lambda s, d: _parsed(s, d).rejected,
        "select distinct '/logs/.codex/sessions/c' || conv_id || '.jsonl' as path from conversations where conv_id % 8 = 1",
    ),
    "log_unknown": (
        lambda s, d: _parsed(s, d).unknown,
        "select distinct '/logs/other/c' || conv_id || '.jsonl' as path from conversations where conv_id % 10 = 3",
    ),
    "log_detection": (
        lambda s, d: logs.detect(logs.read_lines(log_files(s.read.parquet(f"{d}/conversations.parquet")))),
        """select distinct case conv_id % 4 when 0 then '/logs/.claude/projects/proj' || conv_id % 7 || '/' || case when conv_id % 5 = 0 then 'subagents/' else '' end || 'c' || conv_id || '.jsonl'
        when 1 then '/logs/.codex/sessions/c' || conv_id || '.jsonl' when 2 then '/logs/openclaw/' || conv_id || '/' || case when conv_id % 3 = 0 then 'main' else 'helper' end || '.jsonl'
        else '/logs/plain/c' || conv_id || '.jsonl' end as path, ['ClaudeCode', 'CodexCli', 'OpenClaw', 'PiCodingAgent'][conv_id % 4 + 1] as tool from conversations""",
    ),
}


def _paths(spark, d) -> DataFrame:
    """Paths of events under roots of several tools, some under two."""
    roots = F.array(*map(F.lit, ("/h/.claude/projects", "/h/.codex/sessions", "/h/.gemini/history/.codex", "/h/openclaw-sessions", "/h/.pi/agent/sessions", "/h/x.claude/.codex", "/h/other")))
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select("event_id", F.concat(F.element_at(roots, (F.col("event_id") % 7 + 1).cast("int")), F.lit("/"), "event_type", F.lit(".jsonl")).alias("path"))


def _first_lines(spark, d) -> DataFrame:
    """Events as first lines in several formats."""
    events = spark.read.parquet(f"{d}/events.parquet")
    forms = ('{"parentUuid":null,"a":1}', '{"type":"summary"}', '{"id":7,"model":"o3-x"}', '{"generationConfig":{}}', '{"openclaw":1}', '{"type":"session","id":"i","cwd":"/","version":1}', '{"type":"session"}', '{"id":7,"model":"other"}', '{"parentMessageUuid":"u"}', '{"gemini":true}')
    line = F.element_at(F.array(*map(F.lit, forms)), (F.col("event_id") % len(forms) + 1).cast("int"))
    return events.select("event_id", F.try_parse_json(line).alias("v"))


def _traces(spark, d) -> DataFrame:
    """Conversations as rows of a trace table: all but the last message asked, the last one answered."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    last = F.max("turn").over(W.partitionBy("conv_id"))
    rows = c.withColumn("last", last)
    asked = F.array_sort(F.collect_list(F.when(F.col("turn") < F.col("last"), F.struct("turn", "role", F.col("text").alias("content")))))
    body = F.to_json(F.struct(F.struct(F.transform(asked, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"), (F.lit(1768530703000) + F.col("conv_id") * 1000).alias("timestamp")).alias("request"), F.struct(F.max_by("text", "turn").alias("content")).alias("response")))
    return rows.groupBy("conv_id").agg(body.alias("conversation_json")).select(F.lit("2026-01-01T00:00:00Z").alias("timestamp"), F.col("conv_id").cast("string").alias("request_id"), "conversation_json")


def _chats(spark, d) -> DataFrame:
    """Orders as sessions, customers as repositories; some orders have no user."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderkey").cast("string").alias("session_id"), F.col("o_custkey").cast("string").alias("repo_id"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("u"), F.col("o_custkey") % 50)).alias("user_id"),
        F.col("o_orderstatus").alias("agent"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
    )
    repos = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("repo_id"), F.col("c_mktsegment").alias("repo_type_domain"), F.col("c_nationkey").cast("string").alias("repo_type_audience"), F.lit("mit").alias("license_type"))
    return corpora.chat_sessions(orders, repos)


def _inputs(spark, d) -> DataFrame:
    """Events as tool calls with inputs that name paths in several ways."""
    forms = ('{"file_path":"/a/%/x.py"}', '{"path":"/a/./b/../%"}', '{"dir_path":"src//%/"}', '{"directory":"../%/y"}', "/raw/%/z.txt", '{"command":"ls"}', '{"file_path":"","path":"/b/%.d/.hidden"}', "no path")
    form = F.element_at(F.array(*map(F.lit, forms)), (F.col("event_id") % len(forms) + 1).cast("int"))
    calls = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.replace(form, F.lit("%"), F.col("event_type")).alias("input"))
    return behaviour.directories(calls).select("event_id", "dir")


QUERIES |= {
    "tools_by_path": (
        lambda s, d: _paths(s, d).select("event_id", logs.tool_of_path(F.col("path")).alias("tool")),
        "select event_id, ['ClaudeCode', 'CodexCli', 'CodexCli', 'OpenClaw', 'PiCodingAgent', 'ClaudeCode', null][event_id % 7 + 1] as tool from events",
    ),
    "tools_by_first_line": (
        lambda s, d: _first_lines(s, d).select("event_id", logs.tool_of_line(F.col("v")).alias("tool")),
        "select event_id, ['ClaudeCode', 'ClaudeCode', 'CodexCli', 'GeminiCli', 'OpenClaw', 'PiCodingAgent', null, null, 'ClaudeCode', 'GeminiCli'][event_id % 10 + 1] as tool from events",
    ),
    "trace_messages": (
        lambda s, d: logs.trace_entries(_traces(s, d)).select("session_key", "msg_idx", "role", F.unix_seconds("ts").alias("ts"), "text"),
        """with x as (select *, turn = max(turn) over (partition by conv_id) as answer from conversations), y as (select conv_id, turn, answer, case when answer then 'Assistant' else upper(role[1]) || role[2:] end as role, text from x where answer or role in ('user', 'assistant'))
        select conv_id::varchar as session_key, row_number() over (partition by conv_id order by turn) - 1 as msg_idx, role, 1768530703 + conv_id as ts, text from y""",
    ),
    "chat_sessions": (
        _chats,
        """select o_orderkey::varchar as session_id, 'repo_' || sha256(o_custkey::varchar)[1:12] as repo, case when o_orderkey % 3 <> 0 then 'user_' || sha256('u' || o_custkey % 50)[1:12] else 'missing_user' end as "user",
        o_orderstatus as agent, strftime(o_orderdate, '%Y-%m-%d') as created_at, c_mktsegment as repo_type_domain, c_nationkey::varchar as repo_type_audience, case when c_custkey is not null then 'mit' end as license_type, 'transcripts/' || o_orderkey || '.jsonl' as transcript
        from orders left join customer on c_custkey = o_custkey""",
    ),
    "stable_hashes": (
        lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", corpora.stable_hashes("source", "source").alias("source"), P.redacted(F.col("lang")).alias("project")),
        "select doc_id, 'source_' || sha256(source)[1:12] as source, 'project_' || sha256(lang)[1:8] as project from documents",
    ),
    "log_file_filter": (
        lambda s, d: corpora.log_files(s.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(F.lit("/data/"), F.element_at(F.array(*map(F.lit, ("a", corpora.NOT_FOLDERS[0], corpora.NOT_FOLDERS[-1], "b"))), (F.col("event_id") % 4 + 1).cast("int")), F.lit("/"), F.element_at(F.array(*map(F.lit, ("run", corpora.NOT_LOGS[0], corpora.NOT_LOGS[-1].upper()))), (F.col("event_id") % 3 + 1).cast("int")), F.lit(".jsonl")).alias("path"))).select("event_id"),
        "select event_id from events where event_id % 4 in (0, 3) and event_id % 3 = 0",
    ),
    "input_directories": (
        _inputs,
        """select event_id, case event_id % 8 when 0 then '/a/' || event_type when 1 then '/a/' || event_type when 2 then 'src/' || event_type when 3 then '../' || event_type || '/y' when 4 then '/raw/' || event_type
        when 6 then '/b/' || event_type || '.d' end as dir from events""",
    ),
}


def strata(spark, d) -> DataFrame:
    """Sessions, messages and tool calls of each session type, of events and conversations together."""
    a = events_frames(spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value"))
    b = conversation_frames(spark.read.parquet(f"{d}/conversations.parquet"))
    out = None
    for kind in ("Interactive", "Subagent", "Autonomous"):
        for origin, frames in (("events", a), ("conversations", b)):
            part = frames.stratum(kind)
            row = part.sessions.agg(F.count("*").alias("sessions")).crossJoin(part.messages.agg(F.count("*").alias("messages"))).crossJoin(part.tool_calls.agg(F.count("*").alias("tool_calls")))
            row = row.select(F.lit(origin).alias("origin"), F.lit(kind).alias("session_type"), "*")
            out = row if out is None else out.unionByName(row)
    return out
