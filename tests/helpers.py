from tracewright.frames import MESSAGES, SESSIONS, TOOL_CALLS, TOOL_RESULTS, Frames, conform


def frames(spark, sessions: list[dict]) -> Frames:
    """Frames from sessions of messages ``(role, text, {thinking, tools, errors, cls, ts})``."""
    s, m, c, r = [], [], [], []
    for n, one in enumerate(sessions):
        key, pos = f"s{n}", 0
        s.append((key, n, key, one.get("type", "Interactive"), one.get("visibility", "Visible"), one.get("project", "alpha"), one.get("path", f"/logs/{key}.jsonl")))
        for i, message in enumerate(one["messages"]):
            role, text, more = (*message, {})[:3]
            tools, errors = more.get("tools", []), more.get("errors", [])
            m.append((key, i, role, more.get("ts"), text, more.get("thinking"), more.get("cls", "Other" if role != "User" else "HumanDirective"), bool(errors) and role == "User", len(tools)))
            for k, t in enumerate(tools):
                name, payload = t if isinstance(t, tuple) else (t, "{}")
                pos += 1
                c.append((key, i, k, pos, f"{key}-{pos}", name, payload))
            for k, e in enumerate(errors):
                r.append((key, i, k, f"{key}-{pos}", "", e))
    make = spark.createDataFrame
    return Frames(
        conform(make(s, "session_key string, session_ord long, session_id string, session_type string, thinking_visibility string, project string, source_path string"), SESSIONS),
        conform(make(m, "session_key string, msg_idx int, role string, ts timestamp, text string, thinking string, classification string, has_tool_result boolean, n_tool_calls int"), MESSAGES),
        conform(make(c, "session_key string, msg_idx int, call_idx int, pos long, call_id string, name string, input string"), TOOL_CALLS),
        conform(make(r, "session_key string, msg_idx int, res_idx int, tool_use_id string, content string, is_error boolean"), TOOL_RESULTS),
    )


def tools(spark, *sequences):
    return frames(spark, [{"messages": [("Assistant", "", {"tools": [t]}) for t in seq]} for seq in sequences])


def found(result) -> dict:
    import json

    return {r.label: json.loads(r.value_json) for r in result.findings.collect()}
