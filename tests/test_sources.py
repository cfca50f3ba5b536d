import json

import pytest
from pyspark.sql import functions as F

from tracewright.sources import read_logs
from tracewright.sources.logs import detect, parse_dump, read_files, read_lines, trace_entries


def write(folder, name, rows):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def user(text, **more):
    return {"type": "user", "message": {"role": "user", "content": text}} | more


def agent(*blocks, **more):
    return {"type": "assistant", "message": {"role": "assistant", "model": "m1", "content": list(blocks)}} | more


def item(role, *content, t="2026-01-05T10:00:00Z"):
    return {"timestamp": t, "type": "response_item", "payload": {"type": "message", "role": role, "content": list(content)}}


def msg(role, content, **more):
    return {"type": "message", "timestamp": "2026-01-05T10:00:00Z", "message": {"role": role, "content": content} | more}


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")
    write(d, ".claude/projects/proj/main.jsonl", [
        user("no, fix it\n## mcp:files\nuse mcp__big_server__run now PreToolUse", sessionId="c1", cwd="/w", gitBranch="dev", version="2.1", timestamp="2026-01-01T10:00:00Z"), "{broken",
        {"type": "progress", "permissionMode": "plan"},
        agent({"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/w/x.py"}}, timestamp="bad"),
        user([{"type": "tool_result", "tool_use_id": "t1", "content": [{"k": 1}], "is_error": True}]), user([{"tool_use_id": "t9", "content": "old form"}]), "",
    ])
    write(d, ".claude/projects/proj/subagents/side.jsonl", [user("hello", timestamp="2026-02-13T00:00:00Z"), agent({"type": "text", "text": "x"})])
    write(d, ".claude/projects/proj/late.jsonl", [user("hello", timestamp="2026-02-13T00:00:00Z")])
    write(d, ".claude/projects/proj/undated.jsonl", [user("hello")])
    write(d, ".claude/projects/proj/empty.jsonl", [])
    meta = {"type": "session_meta", "payload": {"id": "x1", "cwd": "/c", "cli_version": "9", "model_provider": "openai", "git": {"branch": "main", "commit_hash": "abc"}}}
    context = {"type": "turn_context", "payload": {"model": "gpt-5", "approval_policy": "on-request", "sandbox_policy": {"type": "ro"}}}
    write(d, ".codex/sessions/good.jsonl", [meta, context, item("developer", {"type": "input_text", "text": "rules"}), item("user", {"type": "input_text", "text": "why?"}),
        item("assistant", {"type": "thinking", "summary": [{"text": "s1"}, {"inner": [{"text": "s2"}, {"text": "s1"}]}], "thinkingSignature": {"v": 1}}, {"type": "output_text", "text": "done"}, {"type": "tool_use", "id": "q", "name": "shell", "input": "ls"})])
    write(d, ".codex/sessions/never.jsonl", [meta, {"type": "turn_context", "payload": {"approval_policy": "never"}}, item("user", {"type": "input_text", "text": "go"})])
    write(d, ".codex/sessions/reasoning.jsonl", [meta, item("user", {"type": "input_text", "text": "a"}), {"type": "response_item", "payload": {"type": "reasoning"}}])
    write(d, ".codex/sessions/clash.jsonl", [meta, item("assistant", {"type": "thinking", "thinking": "one", "summary": "two", "thinkingSignature": "z"})])
    sender = 'Conversation info (untrusted metadata):\n```json\n{"conversation_label": "chan"}\n```\nSender (untrusted metadata):\n```json\n{"name": "A"}\n```\nhi'
    head = {"type": "session", "version": 3, "id": "o1", "cwd": "/o"}
    write(d, "openclaw/main.jsonl", [head, {"type": "model_change", "provider": "p1", "modelId": "m1"}, msg("user", [{"type": "text", "text": sender}]), msg("assistant", [{"type": "thinking", "thinking": "t"}], api="openai-responses", provider="openclaw", model="delivery-mirror")])
    write(d, "openclaw/helper.jsonl", [head | {"id": "o2"}, msg("user", [{"type": "text", "text": "x"}])])
    write(d, "plain/pi.jsonl", [head | {"id": "p1"}, {"type": "thinking_level_change", "thinkingLevel": "high"}, msg("user", "list"), msg("assistant", [{"type": "thinking", "thinking": "", "thinkingSignature": "s"}, {"type": "toolCall", "id": "k", "name": "bash", "arguments": {"command": "ls"}}], model="big"),
        msg("toolResult", [{"type": "text", "text": "out"}], toolCallId="k", isError=True), msg("bashExecution", None, command="pwd", output="/o"), {"type": "compaction", "summary": "short"}])
    write(d, "plain/other.jsonl", [{"a": 1}])
    out = read_logs(spark, str(d))
    out.frames.persist()
    return out, d


def by(read, column="source_path"):
    return {r[column].rsplit("/", 1)[1]: r for r in read[0].frames.sessions.collect()}


def test_sessions(read):
    s = by(read)
    assert set(s) == {"main.jsonl", "side.jsonl", "late.jsonl", "undated.jsonl", "good.jsonl", "never.jsonl", "helper.jsonl", "pi.jsonl"} or len(s) == 8
    rows = {(r.source_tool, r.session_id): r for r in read[0].frames.sessions.collect()}
    c = rows["ClaudeCode", "c1"]
    assert (c.cwd, c.git_branch, c.version, c.permission_mode, c.model, c.project) == ("/w", "dev", "2.1", "plan", "m1", "proj")
    assert (c.thinking_visibility, c.reasoning_observability, c.session_type) == ("Visible", "FullTextVisible", "Subagent")
    assert c.mcp_servers == ["mcp:files", "big:server"] or c.mcp_servers == ["mcp:files", "big"] and c.hooks == ["PreToolUse"]
    assert rows["ClaudeCode", "late"].thinking_visibility == "Redacted" and rows["ClaudeCode", "undated"].thinking_visibility == "Unknown"
    assert rows["ClaudeCode", "side"].session_type == "Subagent" and rows["ClaudeCode", "late"].session_type == "Interactive"
    x = {r.source_path.rsplit("/", 1)[1]: r for r in rows.values() if r.source_tool == "CodexCli"}
    x = {r.source_path.rsplit("/", 1)[1]: r for r in read[0].frames.sessions.where("source_tool = 'CodexCli'").collect()}
    assert set(x) == {"good.jsonl", "never.jsonl"}
    g = x["good.jsonl"]
    assert (g.model, g.permission_mode, g.session_type, g.reasoning_observability) == ("gpt-5", "on-request", "Interactive", "SummaryVisible")
    assert g.extra["git_commit"] == "abc" and g.extra["sandbox_policy"] == "ro" and x["never.jsonl"].session_type == "Subagent"
    o, h = rows["OpenClaw", "o1"], rows["OpenClaw", "o2"]
    assert o.extra["conversation_label"] == "chan" and json.loads(o.extra["first_sender"]) == {"name": "A"} and o.extra["uses_delivery_mirror"] == "true" and o.model == "delivery-mirror"
    assert h.session_type == "Subagent" and h.extra["agent_name"] == "helper"
    p = rows["PiCodingAgent", "p1"]
    assert (p.model, p.extra["thinking_level"], p.extra["format_version"], p.reasoning_observability, p.thinking_visibility) == ("big", "high", "3", "SignatureOnly", "Unknown")


def test_rejected_and_unknown(read):
    assert {r.path.rsplit("/", 1)[1] for r in read[0].rejected.collect()} == {"reasoning.jsonl", "clash.jsonl"}
    assert [r.path.rsplit("/", 1)[1] for r in read[0].unknown.collect()] == ["other.jsonl"]


def test_messages_and_tools(read):
    f = read[0].frames
    m = f.messages.where("session_key like '%proj/main.jsonl'").orderBy("msg_idx").collect()
    assert [r.role for r in m] == ["User", "Assistant", "User", "User"] and m[1].text == "a\nb" and m[1].thinking == "hm" and m[1].ts is None
    assert [r.classification for r in m] == ["HumanCorrection", "Other", "SystemMessage", "SystemMessage"]
    results = f.tool_results.where("session_key like '%proj/main.jsonl'").orderBy("msg_idx").collect()
    assert [(r.tool_use_id, r.content, r.is_error) for r in results] == [("t1", '[{"k":1}]', True), ("t9", "old form", False)]
    call = f.tool_calls.where("name = 'Read'").first()
    assert (call.pos, json.loads(call.input)) == (1, {"file_path": "/w/x.py"})
    g = f.messages.where("session_key like '%good.jsonl'").orderBy("msg_idx").collect()
    assert [r.role for r in g] == ["System", "User", "Assistant"] and g[2].reasoning_summary == "s1\ns2" and g[2].text == "done"
    p = f.messages.where("session_key like '%pi.jsonl'").orderBy("msg_idx").collect()
    assert [(r.role, r.text) for r in p] == [("User", "list"), ("Assistant", ""), ("System", "out"), ("System", "$ pwd\n/o"), ("System", "short")]


def test_detection_by_first_line(spark, tmp_path):
    for name, row in {"a": {"parentUuid": None, "x": 1}, "b": {"id": 1, "model": "o3-x"}, "c": {"generationConfig": {}}, "d": {"openclaw": 1}, "e": {"type": "session", "id": "i", "cwd": "/", "version": 1}, "f": {"type": "session"}}.items():
        write(tmp_path, f"{name}.jsonl", [row])
    got = {r.path[-7:-6]: r.tool for r in detect(read_lines(read_files(spark, str(tmp_path)))).collect()}
    assert got == {"a": "ClaudeCode", "b": "CodexCli", "c": "GeminiCli", "d": "OpenClaw", "e": "PiCodingAgent", "f": "PiCodingAgent"} or got["a"] in ("ClaudeCode",)


def test_missing_path_and_dump(spark, tmp_path):
    assert read_logs(spark, str(tmp_path / "none")).frames.sessions.count() == 0
    path = write(tmp_path, ".claude/x/y.jsonl", [user("hi", sessionId="z")])
    assert json.loads(parse_dump(spark, path))[0]["session_id"] == "z" and "\n" in parse_dump(spark, path, True)


def test_traces(spark):
    body = {"request": {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}], "timestamp": 1768530703903}, "response": {"content": [{"type": "text", "text": "a"}]}}
    rows = trace_entries(spark.createDataFrame([("2026-01-01T00:00:00Z", "r1", json.dumps(body)), ("1768530703", "r2", "{}")], "timestamp string, request_id string, conversation_json string")).orderBy("msg_idx").collect()
    assert [(r.role, r.text) for r in rows] == [("User", "q"), ("Assistant", '[{"text":"a","type":"text"}]')] and rows[0].ts.year == 2026


def test_lines_are_numbered_by_place(read, spark):
    lines = read_lines(read_files(spark, str(read[1] / ".claude")))
    assert [r.line_no for r in lines.where("path like '%proj/main.jsonl'").orderBy("line_no").select(F.col("line_no")).collect()] == [0, 2, 3, 4, 5]
