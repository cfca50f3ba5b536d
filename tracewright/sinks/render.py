"""Text, Markdown, JSON, notebook and prompt forms of small results (driver side)."""

from __future__ import annotations

import json
import math
import re

from ..result import TechniqueResult

TABLE_ROWS, HEAD, TAIL, JSON_ROWS = 50, 25, 5, 100_000
BLOCKS = "▁▂▃▄▅▆▇█"


def cell(value) -> str:
    """One value for a Markdown table."""
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return "—"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return str(int(value)) if value == int(value) and abs(value) < 1e15 else f"{value:.4f}"
    return str(value).replace("|", "\\|").replace("\n", " ")


def rows_shown(rows: list, most: int = TABLE_ROWS, head: int = HEAD, tail: int = TAIL) -> list:
    """All rows, or the first and last with a gap (None) between."""
    return rows if len(rows) <= most else [*rows[:head], None, *rows[-tail:]]


def fetched(df) -> list:
    """The rows of a table that are shown: all, or the first and the last ones with a gap (None); no more reach the driver."""
    rows = [tuple(r) for r in df.limit(TABLE_ROWS + 1).collect()]
    return rows if len(rows) <= TABLE_ROWS else [*rows[:HEAD], None, *(tuple(r) for r in df.tail(TAIL))]


def markdown_table(columns: list[str], rows: list) -> str:
    out = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    for row in rows_shown(rows):
        out.append("| " + " | ".join("…" if row is None else cell(v) for v in (row or columns)) + " |")
    return "\n".join(out)


def findings_of(result: TechniqueResult) -> list[tuple[str, object]]:
    return [] if result.findings is None else [(r.label, json.loads(r.value_json) if r.value_json is not None else None) for r in result.findings.collect()]


def markdown(result: TechniqueResult, meta: dict | None = None) -> str:
    """Front matter, findings and tables; tables are cut to a readable length before they leave Spark."""
    parts = ["---", f"technique: {result.name}", *(f"{k}: {v}" for k, v in (meta or {}).items()), "---", "", f"# {result.name}", ""]
    found = findings_of(result)
    if found:
        parts += ["## Findings", "", markdown_table(["Finding", "Value"], [(k, json.dumps(v) if isinstance(v, (dict, list)) else v) for k, v in found]), ""]
    for name, df in result.tables.items():
        parts += [f"## {name}", "", markdown_table(df.columns, fetched(df)), ""]
    return "\n".join(parts)


def as_json(result: TechniqueResult, meta: dict | None = None, pretty: bool = True) -> str:
    tables = []
    for name, df in result.tables.items():
        rows = df.limit(JSON_ROWS + 1).collect()
        if len(rows) > JSON_ROWS:
            raise ValueError(f"table {name!r} has more than {JSON_ROWS} rows; read it from the stored run instead")
        tables.append({"name": name, "columns": df.columns, "rows": [list(map(_plain, r)) for r in rows]})
    body = {"name": result.name, "metadata": meta or {}, "findings": [{"label": k, "value": v} for k, v in findings_of(result)], "tables": tables}
    return json.dumps(body, indent=2 if pretty else None, ensure_ascii=False)


def _plain(v):
    if isinstance(v, float) and not math.isfinite(v):
        return None
    return v if isinstance(v, (type(None), bool, int, float, str)) else str(v)


def sparkline(values: list[float], width: int = 40) -> str:
    """Eight levels; long series are averaged into ``width`` bins; a flat one is all level three."""
    xs = [v for v in values if v is not None and math.isfinite(v)]
    if not xs:
        return ""
    if len(xs) > width:
        cuts = [i * len(xs) // width for i in range(width + 1)]
        xs = [sum(xs[a:b]) / (b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    low, high = min(xs), max(xs)
    return "".join(BLOCKS[3] if high == low else BLOCKS[min(7, int((x - low) / (high - low) * 8))] for x in xs)


def bar(label: str, value: float, most: float, width: int = 40) -> str:
    share = 0 if most <= 0 else max(0.0, min(1.0, value / most))
    return f"{label[:20]:<20} {'█' * round(share * width):<{width}} {cell(float(value))}"


def ascii_table(columns: list[str], rows: list) -> str:
    """Fixed-width table: up to 30 rows, or the first 20 and the last 5."""
    shown = rows_shown(rows, 30, 20, 5)
    text = [[cell(v) for v in r] if r is not None else ["..."] * len(columns) for r in shown]
    wide = [max(len(c), *(len(r[i]) for r in text)) if text else len(c) for i, c in enumerate(columns)]
    line = lambda cells: "  ".join(f"{c:<{w}}" for c, w in zip(cells, wide, strict=True)).rstrip()
    return "\n".join([line(columns), line(["-" * w for w in wide]), *map(line, text)])


def notebook(results: list[TechniqueResult], run: str) -> str:
    """A notebook (format 4.5) with a Markdown and a code cell a technique and the first ten rows of its main table as output."""
    cells, number = [], 0

    def add(kind: str, source: str, outputs: list | None = None):
        nonlocal number
        number += 1
        own = {"cell_type": kind, "id": f"cell-{number}", "metadata": {}, "source": source.splitlines(keepends=True)}
        cells.append(own | ({"execution_count": None, "outputs": outputs or []} if kind == "code" else {}))

    add("markdown", f"# Run {run}")
    for r in results:
        found = findings_of(r)
        add("markdown", f"## {r.name}\n\n" + markdown_table(["Finding", "Value"], [(k, json.dumps(v)) for k, v in found]))
        if r.primary_table is None:
            continue
        df = r.primary_table
        head = [tuple(x) for x in df.limit(10).collect()]
        html = "<table><tr>" + "".join(f"<th>{c}</th>" for c in df.columns) + "</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in row) + "</tr>" for row in head) + "</table>"
        output = {"output_type": "display_data", "metadata": {}, "data": {"text/html": html, "text/plain": ascii_table(df.columns, head)}}
        add("code", f"spark.read.parquet({run + '/' + r.name!r}).limit(10)", [output])
    return json.dumps({"nbformat": 4, "nbformat_minor": 5, "metadata": {"kernelspec": {"name": "python3", "display_name": "Python 3", "language": "python"}}, "cells": cells}, indent=1, ensure_ascii=False)


MARKER = "<!-- technique: {} -->"


def interpretation_prompt(results: list[TechniqueResult], meta: dict) -> str:
    """A prompt asking for one marked section a technique, with its findings and the first ten rows of its main table."""
    parts = ["Interpret the following analysis of agent sessions.", "Write one section for each technique, each after its marker line.", json.dumps(meta), ""]
    for r in results:
        parts += [MARKER.format(r.name), *(f"- {k}: {json.dumps(v)}" for k, v in findings_of(r))]
        if r.primary_table is not None:
            parts.append(markdown_table(r.primary_table.columns, [tuple(x) for x in r.primary_table.limit(10).collect()]))
        parts.append("")
    return "\n".join(parts)


def split_interpretation(text: str) -> tuple[str, dict[str, str]]:
    """What stands before the first marker, and the text of each technique's section."""
    parts = re.split(r"<!--\s*technique:\s*([\w-]+)\s*-->", text)
    if len(parts) < 3:
        raise ValueError("the response has no technique markers")
    return parts[0].strip(), {k: v.strip() for k, v in zip(parts[1::2], parts[2::2], strict=True)}


def conversation_text(frames, session: str, most: int = 20_000, tools: bool = False) -> str:
    """One session as readable text."""
    from pyspark.sql import functions as F

    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.col("text"))
    rows = frames.messages.where(F.col("session_key") == session)
    if tools:
        used = frames.tool_calls.where(F.col("session_key") == session).groupBy("msg_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("call_idx", "name"))), lambda x: x["name"]), ", ").alias("used"))
        rows = rows.join(used, "msg_idx", "left")
        line = F.concat(line, F.when(F.col("used").isNotNull(), F.concat(F.lit("\n  tools: "), F.col("used"))).otherwise(""))
    row = rows.agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", line.alias("t")))), lambda x: x["t"]), "\n\n"), 1, most).alias("t")).first()
    return row.t or ""
