import json
import os

import pytest

from tests.helpers import frames, tools
from tracewright.registry import REGISTRY
from tracewright.result import TechniqueResult
from tracewright.sinks import archive, render, storage


def test_guards(spark):
    df = spark.createDataFrame([("x" * 501, 1)], "name string, n int")
    with pytest.raises(Exception, match="501 bytes"):
        storage.guarded(df).collect()
    assert storage.guarded(spark.createDataFrame([("é" * 250,)], "name string")).count() == 1
    for bad in ("raw_text", "Prompt", "x-cwd"):
        with pytest.raises(storage.GuardError):
            storage.check_columns(df.withColumnRenamed("name", bad))
    storage.check_columns(df.withColumnRenamed("name", "contents_drawer"))


def test_kinds():
    assert [storage.infer_kind(v) for v in ([1, None], [1, 2.0], [True], [True, 1], ["a", 1], [None])] == ["bigint", "double", "boolean", "string", "string", "string"]


def test_run_round_trip(spark, tmp_path):
    f = tools(spark, ["Read", "Edit", "Read", "Bash"], ["Bash"] * 4)
    manifest, failed = storage.analyze(f, str(tmp_path), ["markov", "diversity", "nope"])
    assert failed == {"nope": "unknown technique"} and manifest.sessions == 2 and len(manifest.techniques) == 2
    split, _ = storage.analyze(f, str(tmp_path), ["markov"], split=True)
    assert [t["stratum"] for t in split.techniques] == list(storage.STRATA)
    run, latest = storage.latest_run(spark, str(tmp_path))
    assert latest == manifest and run.endswith(manifest.run_id)  # stratified runs are passed over
    table = next(t for t in manifest.techniques if t["technique"] == "markov")["tables"][0]
    assert table["primary"] and spark.read.parquet(table["path"]).count() == 4
    with pytest.raises(ValueError):
        storage.analyze(f.stratum("Autonomous"), str(tmp_path))
    assert storage.corpus_fingerprint(f.sessions) == __import__("hashlib").sha256(b"/logs/s0.jsonl\n/logs/s1.jsonl\n").hexdigest()
    assert storage.select_techniques(essential=True)[0] == [n for n, t in REGISTRY.items() if t.essential] and len(storage.select_techniques()[0]) == 23


def test_renderers(spark):
    assert [render.cell(v) for v in (None, True, 2.0, 0.12345, "a|b", float("nan"))] == ["—", "yes", "2", "0.1235", "a\\|b", "—"]
    assert len(render.rows_shown(list(range(51)))) == 31 and render.rows_shown(list(range(50))) == list(range(50))
    assert render.sparkline([0, 1, 2, 3, 4, 5, 6, 7]) == render.BLOCKS and set(render.sparkline([2, 2])) == {render.BLOCKS[3]} and len(render.sparkline(list(range(100)), 10)) == 10
    assert render.bar("x" * 30, 1, 2).startswith("x" * 20 + " ████") and render.ascii_table(["a"], [(i,) for i in range(31)]).count("\n") == 27
    r = REGISTRY["markov"].run(tools(spark, ["Read", "Edit"]))
    assert "technique: markov" in render.markdown(r, {"run": "x"}) and "| Read | Edit |" in render.markdown(r)
    assert json.loads(render.as_json(r))["tables"][0]["columns"][0] == "from_tool"
    book = json.loads(render.notebook([r, TechniqueResult("empty")], "run-1"))
    assert book["nbformat_minor"] == 5 and [c["cell_type"] for c in book["cells"]] == ["markdown", "markdown", "code", "markdown"]
    assert "<!-- technique: markov -->" in render.interpretation_prompt([r], {})
    assert render.split_interpretation("intro <!-- technique: a --> x <!-- technique: b-c --> y") == ("intro", {"a": "x", "b-c": "y"})
    with pytest.raises(ValueError):
        render.split_interpretation("nothing")
    f = frames(spark, [{"messages": [("User", "hi"), ("Assistant", "ok", {"tools": ["Read", "Edit"]})]}])
    assert render.conversation_text(f, "s0", tools=True) == "[User] hi\n\n[Assistant] ok\n  tools: Read, Edit"


def test_long_tables_show_their_true_ends(spark):
    df = spark.range(5000).orderBy("id")
    text = render.markdown(TechniqueResult("t", {"T": df}))
    assert "| 0 |" in text and "| 4999 |" in text and "| 4995 |" in text and "| 1000 |" not in text and text.count("\n| ") < 40
    old, render.JSON_ROWS = render.JSON_ROWS, 100
    try:
        with pytest.raises(ValueError, match="more than 100 rows"):
            render.as_json(TechniqueResult("t", {"T": df}))
    finally:
        render.JSON_ROWS = old


def test_archive(spark, tmp_path):
    logs, target = tmp_path / "logs" / ".claude", str(tmp_path / "store")
    logs.mkdir(parents=True)
    (logs / "a.jsonl").write_text('{"type":"user","sessionId":"s","timestamp":"2026-01-01T00:00:00Z"}\n')
    (logs / "b.jsonl").write_text((logs / "a.jsonl").read_text())
    (logs / "c.jsonl").write_text("")
    (logs / "d.jsonl").write_text('{"type":"user"}\n{bad\n')
    roots = [str(logs)]
    with pytest.raises(archive.ArchiveError):
        archive.archive(spark, roots, str(logs / "inside"), consent=True)
    with pytest.raises(archive.ArchiveError):
        archive.archive(spark, [str(tmp_path / "gone")], target, consent=True)
    with pytest.raises(archive.ArchiveError):
        archive.archive(spark, roots, target)
    assert {r.action: r.files for r in archive.archive(spark, roots, target, dry_run=True).collect()} == {"copy": 3, "dedupe": 1}
    assert not os.path.exists(target)
    archive.archive(spark, roots, target, consent=True)
    assert archive.drift(spark, target).count() == 0 and archive.known_observations(spark, target).count() == 4
    assert {r.action for r in archive.archive(spark, roots, target, consent=True).collect()} == {"known"}
    status = {r.path[-7:]: r.status for r in archive.session_index(spark, target).collect()}
    assert status == {"a.jsonl": "parsed", "b.jsonl": "parsed", "c.jsonl": "empty_placeholder", "d.jsonl": "parser_error"}
    stored = next(os.path.join(d, n) for d, _, names in os.walk(f"{target}/objects") for n in names)
    with open(stored, "a") as f:
        f.write("x")
    assert [r.problem for r in archive.drift(spark, target).collect()] == ["changed"]
    assert storage.freeze(spark, str(logs)).where("tool = 'ClaudeCode'").count() == 4


def test_archives_stay_out_of_git(tmp_path):
    inside, outside = tmp_path / "work" / "a" / "store", tmp_path / "store"
    (tmp_path / "work" / ".git").mkdir(parents=True)
    inside.mkdir(parents=True)
    outside.mkdir()
    assert archive.keep_out_of_git(str(outside)) and not (outside / ".gitignore").exists()
    assert archive.keep_out_of_git(str(inside)) and (inside / ".gitignore").read_text() == "*\n!.gitignore\n"
    (inside / ".gitignore").write_text("objects\n")
    assert not archive.keep_out_of_git(str(inside)) and (inside / ".gitignore").read_text() == "objects\n"
