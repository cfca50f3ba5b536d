import json

import pytest

from tests.helpers import frames
from tracewright.plans import behaviour
from tracewright.sources.corpora import chat_tables, load_registry, log_files, select_corpora, stable_hash


def test_registry_fails_closed():
    good = {"name": "a", "repo": "o/a", "revision": "0" * 40, "tier": "smoke"}
    corpora = load_registry(json.dumps({"corpora": [good, good | {"name": "b", "tier": "full"}]}))
    assert [c.name for c in select_corpora(corpora, "smoke")] == ["a"] and len(select_corpora(corpora)) == 2
    for bad in (good | {"revision": "main"}, good | {"tier": "x"}, {k: v for k, v in good.items() if k != "repo"}):
        with pytest.raises(ValueError):
            load_registry(json.dumps({"corpora": [bad]}))
    for args in ({"names": ["z"]}, {"tier": "representative"}):
        with pytest.raises(ValueError):
            select_corpora(corpora, **args)


def test_files_and_tables(spark, tmp_path):
    paths = ["/c/a.jsonl", "/c/metadata.jsonl", "/c/indexes/x.jsonl", "/c/.cache/y.jsonl", "/c/sub/b.jsonl"]
    assert [r.path for r in log_files(spark.createDataFrame([(p, "") for p in paths], "path string, content string")).orderBy("path").collect()] == ["/c/a.jsonl", "/c/sub/b.jsonl"]
    spark.createDataFrame([("s1", "r1", "u1", "x", "t", "o"), ("", "r9", None, "x", "t", "o")], "session_id string, repo_id string, user_id string, agent string, created_at string, owner_id string").write.parquet(str(tmp_path / "sessions.parquet"))
    spark.createDataFrame([("r1", "web", "dev", "mit")], "repo_id string, repo_type_domain string, repo_type_audience string, license_type string").write.parquet(str(tmp_path / "repositories.parquet"))
    rows = {r.session_id: r for r in chat_tables(spark, str(tmp_path)).collect()}
    assert rows["s1"].user == stable_hash("u1", "user") and rows["s1"].transcript == "transcripts/s1.jsonl" and rows["s1"].license_type == "mit"
    assert rows[""].user == "missing_user" and rows[""].transcript is None


def test_scores_and_merged_turns(spark):
    f = frames(spark, [{"messages": [("User", "no, that is wrong"), ("Assistant", "a", {"thinking": "Maybe a risk"}), ("Assistant", "bc", {"thinking": "then next"}), ("User", "what is it?", {"cls": "HumanCorrection"}), ("Assistant", "x")]}])
    s = behaviour.scored_messages(f.messages).orderBy("msg_idx").collect()
    assert s[0].correction == pytest.approx(0.75) and s[0].best == "correction" and s[1].question == 0.8
    t = behaviour.merged_turns(f.messages).orderBy("first_idx").collect()
    assert [(r.first_idx, r.text_len, r.uncertainty, r.risk, r.plan, r.corrected) for r in t] == [(1, 3, 1, 1, 2, True), (4, 1, 0, 0, 0, False)]
