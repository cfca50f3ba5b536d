import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from tests.helpers import found, frames, tools
from tracewright.plans import behaviour, numeric, process, sequence, trends
from tracewright.plans.classify import classify_frames
from tracewright.registry import REGISTRY


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_markov(spark):
    r = REGISTRY["markov"].run(tools(spark, ["Read", "Edit", "Read", "Bash"]))
    assert rows(r.tables["transition_matrix"], "from_tool", "to_tool", "probability") == [("Edit", "Read", 1.0), ("Read", "Bash", 0.5), ("Read", "Edit", 0.5)]
    f = found(r)
    assert f["total_bigrams"] == 3 and f["entry_tool_Read"] == 1 and f["top_transition_1"] == {"from": "Edit", "to": "Read", "probability": 1.0}
    f = found(REGISTRY["markov"].run(tools(spark, ["Bash"] * 4)))
    assert f["self_loop_Bash"] == 1.0 and f["stationary_Bash"] == pytest.approx(1)
    assert rows(sequence.transitions(tools(spark, ["A"], ["B"]).tool_calls), "n") == []


def brute_entropy(w):
    pairs = list(zip(w, w[1:], strict=False))
    return -sum(1 / len(pairs) * math.log2(pairs.count(p) / [x for x, _ in pairs].count(p[0])) for p in pairs)


def test_entropy(spark):
    mixed = list("ABCABDABCADDDBCABCABBACDABCDDA")
    w = sequence.entropy_windows(tools(spark, ["Read", "Edit"] * 30, ["Bash"] * 30, ["x"] * 10, mixed).tool_calls).collect()
    by = {k: [r.entropy for r in sorted(w, key=lambda r: r.start) if r.session_key == k] for k in ("s0", "s1", "s2", "s3")}
    assert max(by["s0"]) < 1e-10 and max(by["s1"]) < 1e-10 and by["s2"] == []
    assert by["s3"] == pytest.approx([brute_entropy(mixed[i : i + 20]) for i in range(len(mixed) - 19)])
    f = found(REGISTRY["entropy"].run(tools(spark, mixed)))
    assert f["sessions_analyzed"] == 1 and f["mean_entropy"] == pytest.approx(np.mean(by["s3"]))


def test_burstiness(spark):
    b = {r.tool_name: r for r in sequence.tool_burstiness(tools(spark, ["A", "B", "C"] * 10)).collect()}
    assert b["A"].burstiness_b == pytest.approx(-1, abs=0.1) and b["A"].memory_m == 0
    b = {r.tool_name: r for r in sequence.tool_burstiness(tools(spark, ["X", "A", "A", "A", "A", "X"])).collect()}
    assert b["X"].burstiness_b == -1 and b["X"].memory_m is None and b["A"].burstiness_b == 1.0


def test_burstiness_crosses_sessions_and_intervals(spark):
    rng = np.random.default_rng(0)
    seqs = [list(rng.choice(list("ABC"), rng.integers(1, 30))) for _ in range(40)]
    got = {r.tool_name: r for r in sequence.tool_burstiness(tools(spark, *seqs)).collect()}
    flat = [t for s in seqs for t in s]
    for t in "ABC":
        at = np.flatnonzero(np.array(flat) == t)
        gap = np.diff(at) - 1
        assert got[t].burstiness_b == pytest.approx((gap.std() - gap.mean()) / (gap.std() + gap.mean()))
        assert got[t].memory_m == pytest.approx(np.corrcoef(gap[:-1], gap[1:])[0, 1])


def test_diversity(spark):
    t = sequence.session_diversity(tools(spark, ["A", "B", "C", "D"] * 3, ["A"] * 5, [])).collect()
    by = {r.session_key: r for r in t}
    assert by["s0"].shannon == pytest.approx(math.log(4)) and by["s0"].simpson == pytest.approx(0.75) and by["s0"].evenness == pytest.approx(1)
    assert by["s1"].evenness == 0 and by["s2"].abundance == 0 and by["s2"].evenness == 0
    area = spark.createDataFrame([(10, 3), (100, 7), (1000, 15)], "abundance int, richness int")
    fit = sequence.species_area(area).first()
    assert fit.z == pytest.approx(0.35, abs=0.05) and fit.r_squared > 0.95
    assert found(REGISTRY["diversity"].run(tools(spark, ["A"] * 5, ["B"] * 4, ["A", "B", "C"])))["monoculture_count"] == 2


def users(*classes, **more):
    return {"messages": [("User", "x", {"cls": "HumanCorrection" if c == "c" else "HumanDirective"}) for c in classes], **more}


def test_correction_rate(spark):
    f = frames(spark, [users(*"cc", *"d" * 8)])
    assert found(REGISTRY["correction-rate"].run(f))["overall_mean_rate"] == 0.2
    s = behaviour.correction_sessions(frames(spark, [users(*"d" * 6, *"ccc")])).first()
    assert (s.rate0, s.rate2, s.degradation) == (0, 1, math.inf)
    r = REGISTRY["correction-rate"].run(frames(spark, [users(*"cddd"), users(*"cccddd")]))
    p = r.tables["per_project"].first()
    assert p.correction_rate == pytest.approx(0.4) and p.project.startswith("project_") and found(r)["overall_mean_rate"] == pytest.approx(0.375)
    assert behaviour.correction_sessions(frames(spark, [users(*"cd")])).first().c0 == 1


def test_thinking_divergence(spark):
    think = lambda t, x: ("Assistant", x, {"thinking": t})
    f = frames(spark, [{"messages": [think("a risk, error", "the risk")]}, {"messages": [think("failure", "")], "visibility": "Redacted"}, {"messages": [think("edge case but ok", "")]}])
    r = found(REGISTRY["thinking-divergence"].run(f))
    assert r["total_risk_tokens"] == 4 and r["suppressed_tokens"] == 3 and r["suppression_rate"] == 0.75
    assert r["skipped_redacted_sessions"] == 1 and r["sessions_with_thinking"] == 2 and r["messages_with_both"] == 1
    one = REGISTRY["thinking-divergence"].run(frames(spark, [{"messages": [think("x" * 12, "y" * 6)]}])).tables["per_session"].first()
    assert one.divergence_ratio == 2.0


CLASSES = [
    ("no, that is not it", "HumanCorrection"), ("looks good", "HumanApproval"), ("how does it work", "HumanQuestion"), ("is it ok?", "HumanApproval"), ("add a file", "HumanDirective"),
    ("my token here", "HumanDirective"), ("goody bag", "HumanDirective"), ("<system-reminder>no, stop</system-reminder>", "SystemMessage"), ("x" * 1200, "Other"), ("é no é", "HumanCorrection"),
    ("undo_this", "HumanCorrection"), ("please fix.it", "HumanCorrection"), ("done?", "HumanQuestion"), ("", "HumanDirective"),
]


def test_message_and_session_classes(spark):
    f = frames(spark, [{"messages": [("User", "start")] + [("User", t) for t, _ in CLASSES] + [("Assistant", "no, wrong")]}, {"messages": [("User", "", {"errors": [False]})]}, {"messages": [("User", "<feedback>")]}, {"messages": [("Assistant", "a")]}, {"messages": [("User", "hello")], "path": "/x/agent-a1.jsonl"}, {"messages": [("User", "y" * 2000)]}])
    out = classify_frames(f)
    got = [r.classification for r in out.messages.where("session_key = 's0'").orderBy("msg_idx").collect()]
    assert got == ["HumanDirective", *(c for _, c in CLASSES), "Other"]
    assert [r.session_type for r in out.sessions.orderBy("session_ord").collect()] == ["Interactive", "Subagent", "Autonomous", "Unknown", "Subagent", "Interactive"]


def test_foraging(spark):
    read = lambda p: ("Read", f'{{"file_path": "{p}"}}')
    f = frames(spark, [{"messages": [("Assistant", "", {"tools": t}) for t in ([read("/a/x.py")], [read("/a/./y.py")], [], [read("/a/z.py")], [read("/b/c/../w.py"), ("Edit", '{"path": "/c"}')])]}])
    v = behaviour.patch_visits(behaviour.foraging_turns(f))
    assert rows(v, "patch", "residence", "first_turn") == [("/a", 1, 4), ("/a", 2, 1), ("/b", 1, 5)]
    r = found(REGISTRY["information-foraging"].run(f))
    assert r["mvt_compliance_rate"] == 0.0 and r["patch_revisit_rate"] == pytest.approx(1 / 3) and r["explore_exploit_ratio"] == 4.0


def test_process_mining_modes(spark):
    f = frames(spark, [{"messages": [("User", "x"), ("Assistant", "", {"tools": ["Read", "Edit"]}), ("User", "y", {"cls": "HumanCorrection"})]}])
    assert [r.symbol for r in process.activities(f).orderBy("pos").collect()] == ["user_request", "other", "user_correction"]
    assert [r.symbol for r in process.activities(f, True).orderBy("pos").collect()] == ["user_request", "search_code", "edit_file", "user_correction"]
    assert found(REGISTRY["process-mining"].run(f))["top_correction_predecessor"] == "other"
    log = process.event_log(tools(spark, list("AABBA")).tool_calls)
    assert rows(process.variants(log), "variant", "sessions") == [("A>B>A", 1)]
    assert rows(process.activity_stats(log), "symbol", "frequency", "mean_dwell") == [("A", 3, 1.5), ("B", 2, 2.0)]


def test_lag_residuals_cover_all_cells(spark):
    cells = process.lag_residuals(process.event_log(tools(spark, list("ABABABABCC")).tool_calls), 2).collect()
    assert {(r["from"], r["to"]) for r in cells if r.lag == 1} >= {("A", "A"), ("A", "B"), ("B", "C")}
    one = next(r for r in cells if r.lag == 1 and (r["from"], r["to"]) == ("A", "B"))
    assert one.observed == 4 and one.expected == pytest.approx(4 * 4 / 9) and one.z_score > 2


def test_survival(spark):
    f = frames(spark, [users(*"dc"), users(*"ddc"), users(*"dddd"), users(*"dc")])
    t = trends.correction_times(f)
    assert rows(t, "duration", "event") == [(2, True), (2, True), (3, True), (4, False)]
    assert [(r.duration, r.at_risk, round(r.survival, 6)) for r in trends.kaplan_meier(t).orderBy("duration").collect()] == [(2, 4, 0.5), (3, 2, 0.25), (4, 1, 0.25)]
    assert trends.nelson_aalen(t).orderBy("duration").collect()[-1].hazard == pytest.approx(1.0)
    gone = spark.createDataFrame([(1, True), (2, True)], "duration int, event boolean")
    assert trends.kaplan_meier(gone).orderBy("duration").collect()[-1].survival == 0.0


def test_log_rank_without_difference(spark):
    t = spark.createDataFrame([(i % 5 + 1, i % 3 > 0, f"g{i % 2}") for i in range(60)], "duration int, event boolean, g string")
    out = trends.log_rank(t, "g").collect()
    assert sum(r.expected for r in out) == pytest.approx(sum(r.observed for r in out)) and all(r.chi2 < 1 for r in out)


def test_cusum_is_the_recurrence(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=80) + np.r_[np.zeros(40), np.ones(40)]
    p = spark.createDataFrame([(f"d{i:03}", float(v), datetime(2024, 1, 1) + timedelta(days=i), 0) for i, v in enumerate(x)], "session_id string, v double, ts timestamp, session_ord int")
    points = trends.in_order(p, "v")
    lim = trends.control_limits(points).first()
    hi = lo = 0.0
    for r, v in zip(trends.cusum(points).orderBy("i").collect(), x, strict=True):
        hi, lo = max(0.0, hi + v - lim["mean"] - lim.sigma / 2), max(0.0, lo + lim["mean"] - lim.sigma / 2 - v)
        assert (r.s_hi, r.s_lo) == (pytest.approx(hi, abs=1e-9), pytest.approx(lo, abs=1e-9)) and r.alarm == (max(hi, lo) > 4 * lim.sigma)
    assert lim.mr_bar == pytest.approx(np.abs(np.diff(x)).mean())


def test_user_signals(spark):
    texts = ["", "<system-reminder>x</system-reminder>", "日本語だけのテキスト", "no, stop", "I SAID STOP DOING THAT NOW PLEASE", "hmm ok", "make it so", "what is this?"]
    s = behaviour.user_signals(frames(spark, [{"messages": [("User", t) for t in texts]}]).messages).orderBy("msg_idx").collect()
    assert [r.state for r in s] == ["boilerplate", "other_language"] + ["classified"] * 5
    assert s[2].categories == ["correction"] and s[2].score == 2 and s[3].score == 5 and s[4].score == 1 and s[5].categories == ["directive"] and s[6].categories == ["question"]
    e = behaviour.escalations(behaviour.user_signals(frames(spark, [{"messages": [("User", t) for t in ["hmm", "no", "i said so", "fine then"]]}]).messages)).collect()
    assert [(r.start_index, r.length, r.peak_intensity) for r in e] == [(0, 3, 3)]


def test_codes_of_turns(spark):
    f = frames(spark, [{"messages": [("User", "there is a bug"), ("System", "plan"), ("Assistant", "maybe I should check", {"tools": ["Read"]}), ("Assistant", "next step")]}])
    c = behaviour.code_columns(f.messages).orderBy("msg_idx").collect()
    assert [r.PROBLEM_FRAMING for r in c] == [1, 0, 0] and c[1].HYPOTHESIS and c[1].EVIDENCE_SEEK and c[1].TOOL_USE and c[2].PLAN
    n = behaviour.network_sessions(behaviour.code_columns(f.messages)).first()
    assert n["PROBLEM_FRAMING|HYPOTHESIS"] == pytest.approx(2 / 3)


def test_projects_graph(spark):
    f = frames(spark, [{"messages": [("User", "see Beta, like beta does"), ("System", "beta")], "project": "alpha"}, {"messages": [("Assistant", "alphabet alpha commit")], "project": "beta"}, {"messages": [("User", "x")], "project": "gamma"}])
    r = REGISTRY["cross-project-graph"].run(f)
    g = found(r)
    assert (g["total_edges"], g["total_references"], g["mutual_pair_count"], g["cluster_count"]) == (2, 3, 1, 1)
    assert {x.dominant_type for x in r.tables["Edges"].collect()} == {"implementation", "cross_project_action"}


def test_timeline(spark):
    day = lambda d: datetime(2026, 3, d, 12)
    one = lambda p, d: {"project": p, "messages": [("User", "x", {"ts": d and day(d)})]}
    f = found(REGISTRY["corpus-timeline"].run(frames(spark, [one("a", 1), one("b", 1), one("c", 1), one("a", 2), one("a", None)])))
    assert (f["total_sessions"], f["undated_sessions"], f["total_dates"], f["high_concurrency_day_count"], f["peak_day"]) == (5, 1, 2, 1, "2026-03-01")


def test_excitation_decay_and_neighbours(spark):
    log = process.event_log(tools(spark, list("ABABABABABABABABAB")).tool_calls)
    e = {(r.trigger, r.response): r.excitation for r in process.excitation(log, (3,)).collect()}
    assert e["A", "B"] > e["A", "A"]
    d = {r.lag: r.rate for r in process.decay(log, "A", 2).collect()}
    assert d == {1: 0.0, 2: 1.0}
    assert rows(process.cascades(process.event_log(tools(spark, list("AABBBBAAA")).tool_calls), "A", 1), "length", "first_pos") == [(2, 1), (3, 7)]
    b = process.beta_diversity(spark.createDataFrame([("x", "A", 2), ("x", "B", 2), ("y", "B", 1), ("z", "C", 1)], "group string, symbol string, n long"))
    assert rows(b, "a", "b", "jaccard", "bray_curtis") == [("x", "y", 0.5, 0.5), ("x", "z", 1.0, 1.0), ("y", "z", 1.0, 1.0)]


def test_patterns_and_strata(spark):
    seqs = [["A", "x", "B", "C"], ["A", "B", "y", "C"], ["A", "B", "C"], ["C", "B", "A"]]
    p = {r.pattern: r.support for r in process.frequent_patterns(process.event_log(tools(spark, *seqs).tool_calls)).collect()}
    assert p["A>B>C"] == 3
    f = frames(spark, [{"messages": [("User", "x")], "type": t} for t in ("Interactive", "Subagent", "Unknown", "Interactive")])
    assert f.stratum("Interactive").messages.count() == 2 and f.stratum("Autonomous").sessions.count() == 0


@pytest.mark.parametrize("name", list(REGISTRY))
def test_every_technique_on_a_small_and_an_empty_corpus(spark, name):
    rng = np.random.default_rng(5)
    names, start = ["Read", "Edit", "Bash", "Grep", "Skill"], datetime(2026, 1, 1)

    def session(i):
        out = []
        for t in range(16):
            out.append(("User", rng.choice(["no, wrong", "do this", "great", "why is it beta?"]), {"cls": rng.choice(["HumanCorrection", "HumanDirective", "HumanApproval"]).item(), "ts": start + timedelta(hours=30 * i + t)}))
            out.append(("Assistant", "maybe a plan " * int(rng.integers(0, 5)), {"tools": rng.choice(names, rng.integers(0, 4)).tolist(), "thinking": "risk" if rng.random() < 0.5 else None, "errors": [bool(rng.random() < 0.3)]}))
        return {"messages": out, "project": ["alpha", "beta", "gamma"][i % 3]}

    full = REGISTRY[name].run(frames(spark, [session(i) for i in range(16)]))
    assert full.findings.columns == ["technique", "label", "value_json", "description"] and full.findings.count() >= 1
    for df in full.tables.values():
        assert not {"text", "content", "thinking"} & set(df.columns)
        df.count()
    none = REGISTRY[name].run(frames(spark, [{"messages": []}]).stratum("Autonomous"))
    none.findings.count()
    for df in none.tables.values():
        df.count()


def test_hidden_states_are_found():
    rng = np.random.default_rng(0)
    seqs = []
    for _ in range(30):
        state, out = 0, []
        for _ in range(40):
            state = state if rng.random() < 0.9 else 1 - state
            out.append(rng.normal([0, 4][state], 0.5, 2))
        seqs.append(np.array(out))
    model = numeric.best_hmm(seqs, range(2, 4))
    assert len(model.start) == 2 and np.allclose(sorted(model.mean[:, 0]), [0, 4], atol=0.2) and np.allclose(np.diag(model.move), 0.9, atol=0.05)
    assert set(np.unique(model.viterbi(seqs[0]))) <= {0, 1}


def test_granger_finds_the_cause():
    rng = np.random.default_rng(3)
    a = rng.normal(size=200)
    b = np.r_[0, a[:-1]] + 0.1 * rng.normal(size=200)
    assert numeric.granger_p(a, b, 2) < 1e-10 < 0.01 < numeric.granger_p(b, a, 2)
    assert numeric.granger_p(np.ones(50), a[:50], 2) is None


def test_cox_recovers_a_coefficient():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    t = rng.exponential(1 / np.exp(1.0 * x[:, 0]))
    event = t < 2
    beta, se, c = numeric.cox_fit(x, np.minimum(t, 2), event)
    assert beta[0] == pytest.approx(1, abs=3 * se[0]) and beta[1] == pytest.approx(0, abs=3 * se[1]) and c > 0.65


def test_adoption_models():
    t = np.arange(60)
    y = 50 / (1 + np.exp(-0.3 * (t - 25)))
    model, r2, k, mid = numeric.fit_adoption(t, y)
    assert r2 > 0.99 and (model != "logistic" or (k == pytest.approx(0.3, abs=0.05) and mid == pytest.approx(25, abs=2)))
    model, r2, beta, _ = numeric.fit_adoption(t, numeric.sir_curve(0.6, 0.1, 59, 60))
    assert r2 > 0.95


def test_time_patterns():
    codes = np.array([0, 1, 2] * 60)
    found_ = {p for p, *_ in numeric.significant_pairs(codes, ["A", "B", "C"], window=1)}
    assert found_ == {"A->B", "B->C", "C->A"}


def test_topics_and_fingerprints():
    import pandas as pd

    rows = [(d, t, 1.0) for d in range(20) for t in (("a", "b") if d % 2 else ("c", "d"))]
    w, h, names = numeric.topics(pd.DataFrame(rows, columns=["doc_id", "term", "weight"]), 2)
    assert {tuple(sorted(names[j] for j in np.argsort(-h[t])[:2])) for t in range(2)} == {("a", "b"), ("c", "d")}
    assert numeric.fingerprint("AB" * 50) == numeric.fingerprint("AB" * 500) != numeric.fingerprint("AC" * 50)
    assert numeric.fingerprint_distance("AB" * 50, "AB" * 400) < numeric.fingerprint_distance("AB" * 50, "CDE" * 60)
