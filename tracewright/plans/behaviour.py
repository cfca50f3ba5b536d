"""Techniques on messages: corrections, suppressed risk, foraging, epistemic codes, user signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import Frames
from ..functions import patterns as P
from ..operators.ordered import runs
from ..result import TechniqueResult, findings_of, technique, union

# --- correction rate ---


def correction_thirds(messages: DataFrame) -> DataFrame:
    """User messages and corrections of each session, whole and by thirds.

    With k = n // 3 the thirds are [0, k), [k, 2k) and the rest; sessions with
    fewer than three user messages are all first third.
    """
    own = W.partitionBy("session_key")
    rows = messages.where("role = 'User'").select(
        "session_key",
        (F.col("classification") == "HumanCorrection").cast("int").alias("hit"),
        (F.row_number().over(own.orderBy("msg_idx")) - 1).alias("i"),
        F.count("*").over(own).alias("n"),
    )
    k = F.floor(F.col("n") / 3)
    third = F.when((F.col("n") < 3) | (F.col("i") < k), 0).when(F.col("i") < 2 * k, 1).otherwise(2)
    rows = rows.withColumn("third", third)
    part = lambda t: (F.sum(F.when(F.col("third") == t, F.col("hit")).otherwise(0)), F.count_if(F.col("third") == t))
    return rows.groupBy("session_key").agg(
        F.count("*").alias("user_messages"), F.sum("hit").alias("corrections"),
        *(x.alias(f"{name}{t}") for t in range(3) for name, x in zip(("c", "n"), part(t), strict=True)),
    )


def correction_sessions(frames: Frames) -> DataFrame:
    """Rates of each session; ``degradation`` is last over first third, infinite where only the first is 0."""
    rows = frames.sessions.select("session_key", "project").join(correction_thirds(frames.messages), "session_key", "left").na.fill(0)
    rate = lambda c, n: F.coalesce(F.try_divide(F.col(c), F.col(n)), F.lit(0.0))
    rows = rows.select("*", rate("corrections", "user_messages").alias("rate"), *(rate(f"c{t}", f"n{t}").alias(f"rate{t}") for t in range(3)))
    worse = F.when(F.col("rate0") > 0, F.col("rate2") / F.col("rate0")).when(F.col("rate2") > 0, F.lit(float("inf"))).otherwise(0.0)
    return rows.withColumn("degradation", worse)


def correction_projects(sessions: DataFrame) -> DataFrame:
    named = F.coalesce(P.redacted(F.col("project")), F.lit("unknown"))
    by = sessions.groupBy(named.alias("project")).agg(F.sum("corrections").alias("corrections"), F.sum("user_messages").alias("user_messages"), F.count("*").alias("session_count"))
    return by.select("project", F.coalesce(F.try_divide("corrections", "user_messages"), F.lit(0.0)).alias("correction_rate"), "corrections", "user_messages", "session_count")


@technique("correction-rate", essential=True, needs=("sessions", "messages"))
def correction_rate(frames: Frames) -> TechniqueResult:
    """How often users correct, over sessions, thirds and projects."""
    rows = correction_sessions(frames)
    finite = F.col("degradation") != float("inf")
    total = lambda t: F.coalesce(F.try_divide(F.sum(f"c{t}"), F.sum(f"n{t}")), F.lit(0.0))
    row = rows.agg(
        F.avg("rate").alias("overall_mean_rate"), F.percentile("rate", F.lit(0.5)).alias("overall_median_rate"),
        F.concat(F.count_if(F.col("corrections") > 0).cast("string"), F.lit("/"), F.count("*").cast("string")).alias("sessions_with_corrections"),
        F.avg(F.when(finite, F.col("degradation"))).alias("mean_degradation_ratio"),
        total(0).alias("first_third_rate"), total(1).alias("middle_third_rate"), total(2).alias("last_third_rate"),
    )
    table = rows.select(
        F.col("session_key").alias("session_id"), F.col("rate").alias("correction_rate"), F.col("rate0").alias("first_third_rate"), F.col("rate2").alias("last_third_rate"),
        F.when(finite, F.col("degradation")).alias("degradation_ratio"), "corrections", "user_messages",
    )
    return TechniqueResult("correction-rate", {"per_session": table, "per_project": correction_projects(rows)}, findings_of("correction-rate", row))


# --- thinking divergence ---


def risk_tokens(rows: DataFrame, thinking: str = "thinking", text: str = "text") -> DataFrame:
    """``rows`` with ``risk``, the risk words present in the thinking, and ``hidden``, those not in the text."""
    words = F.array(*map(F.lit, P.RISK_TOKENS))
    inside = lambda column: lambda w: F.rlike(F.coalesce(F.col(column), F.lit("")), F.concat(F.lit(r"(?i)\b"), w, F.lit(r"\b")))
    # One pass for all words decides whether the 51 need be looked at one by one.
    some = F.coalesce(F.col(thinking), F.lit("")).rlike(r"(?i)\b(" + "|".join(P.RISK_TOKENS) + r")\b")
    risk = F.when(some, F.filter(words, inside(thinking))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("risk", risk)
    return rows.withColumn("hidden", F.filter("risk", lambda w: ~inside(text)(w)))


def divergence_sessions(frames: Frames) -> DataFrame:
    """Risk words and lengths (in bytes) of each session's thinking messages; redacted sessions are left out."""
    visible = frames.sessions.where("coalesce(thinking_visibility, '') <> 'Redacted'").select("session_key", "thinking_visibility")
    rows = frames.messages.where("role = 'Assistant' and thinking is not null").join(visible, "session_key")
    rows = risk_tokens(rows)
    return rows.groupBy("session_key", "thinking_visibility").agg(
        F.sum(F.octet_length("thinking")).alias("thinking_length"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("text_length"),
        F.count_if(F.octet_length("text") > 0).alias("both"), F.sum(F.size("risk")).alias("risk"), F.sum(F.size("hidden")).alias("hidden"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("risk")))), ", ").alias("risk_tokens"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hidden")))), ", ").alias("suppressed_tokens"),
    )


@technique("thinking-divergence", essential=True, needs=("sessions", "messages"))
def thinking_divergence(frames: Frames) -> TechniqueResult:
    """Risk words in thinking that the visible text suppresses."""
    rows = divergence_sessions(frames)
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    row = rows.agg(
        share(F.sum("hidden"), F.sum("risk")).alias("suppression_rate"), share(F.sum("thinking_length"), F.sum("text_length")).alias("divergence_ratio"),
        F.count("*").alias("sessions_with_thinking"), F.coalesce(F.sum("both"), F.lit(0)).alias("messages_with_both"),
        F.coalesce(F.sum("risk"), F.lit(0)).alias("total_risk_tokens"), F.coalesce(F.sum("hidden"), F.lit(0)).alias("suppressed_tokens"),
    )
    kind = F.coalesce("thinking_visibility", F.lit("Unknown"))
    sizes = frames.sessions.agg(
        F.count_if(kind != "Redacted").alias("sessions_analyzed"), F.count_if(kind == "Redacted").alias("skipped_redacted_sessions"),
        F.count_if(kind == "Visible").alias("analyzed_visible_sessions"), F.count_if(kind == "Unknown").alias("analyzed_unknown_sessions"),
    )
    table = rows.select(
        F.col("session_key").alias("session_id"), share(F.col("hidden"), F.col("risk")).alias("suppression_rate"),
        share(F.col("thinking_length"), F.col("text_length")).alias("divergence_ratio"), "thinking_length", "text_length", "risk_tokens", "suppressed_tokens",
    )
    return TechniqueResult("thinking-divergence", {"per_session": table}, union(findings_of("thinking-divergence", row), findings_of("thinking-divergence", sizes)))


# --- information foraging ---


def normal_path(path):
    """The path without empty, ``.`` and inner ``..`` parts."""
    start = F.struct(F.array().cast("array<string>").alias("kept"))

    def step(acc, part):
        kept = acc["kept"]
        last = F.get(kept, F.size(kept) - 1)
        back = (part == "..") & (F.size(kept) > 0) & (last != "..")
        rooted = (part == "..") & (F.size(kept) == 0) & F.startswith(path, F.lit("/"))
        return F.struct(F.when(part.isin("", ".") | rooted, kept).when(back, F.slice(kept, 1, F.size(kept) - 1)).otherwise(F.array_append(kept, part)).alias("kept"))

    joined = F.array_join(F.aggregate(F.split(path, "/"), start, step, lambda acc: acc["kept"]), "/")
    rooted = F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), joined)
    return F.when(rooted == "", ".").otherwise(rooted)


def directories(calls: DataFrame) -> DataFrame:
    """``calls`` with ``dir``, the directory its input names, if any."""
    parsed = F.try_parse_json("input")
    key = lambda k: F.try_variant_get(parsed, f"$.{k}", "string")
    first = F.coalesce(*(F.nullif(key(k), F.lit("")) for k in ("file_path", "path", "dir_path", "directory")))
    raw = F.when(parsed.isNull() & F.contains("input", F.lit("/")), F.col("input"))
    path = normal_path(F.col("__path"))
    base = F.regexp_extract(F.col("__norm"), "[^/]*$", 0)
    parent = F.regexp_replace(F.col("__norm"), "/?[^/]*$", "")
    rooted = F.when((parent == "") & F.startswith("__norm", F.lit("/")), "/").when(parent == "", ".").otherwise(parent)
    rows = calls.withColumn("__path", F.coalesce(first, raw)).withColumn("__norm", F.when(F.col("__path").isNotNull(), path))
    return rows.withColumn("dir", F.when(F.contains(base, F.lit(".")) & (base != ""), rooted).otherwise(F.col("__norm"))).drop("__path", "__norm")


def patch_visits(turns: DataFrame) -> DataFrame:
    """Visits of ``session_key, turn, patch``: runs of turns in one patch; a turn without patch ends the run."""
    visited = runs(turns, ["session_key"], ["turn"], ["patch"])
    return visited.where("patch is not null").groupBy("session_key", "run", "patch").agg(F.count("*").alias("residence"), F.min("turn").alias("first_turn"))


def foraging_turns(frames: Frames) -> DataFrame:
    """Assistant turns: least directory, exploring and exploiting calls."""
    low = F.lower("name")
    explore = low.isin("read", "glob", "grep", "websearch", "webfetch")
    calls = directories(frames.tool_calls).groupBy("session_key", "msg_idx").agg(F.min("dir").alias("patch"), F.count_if(explore).alias("explore"), F.count_if(~explore).alias("exploit"))
    turns = frames.messages.where("role = 'Assistant'").select("session_key", "msg_idx", F.row_number().over(W.partitionBy("session_key").orderBy("msg_idx")).alias("turn"))
    return turns.join(calls, ["session_key", "msg_idx"], "left").na.fill(0, ["explore", "exploit"])


def foraging_sessions(turns: DataFrame, visits: DataFrame) -> DataFrame:
    """Metrics of sessions with at least one visit."""
    by = visits.groupBy("session_key").agg(F.count("*").alias("visits"), F.count_distinct("patch").alias("patches"), F.avg("residence").alias("residence"))
    calls = turns.groupBy("session_key").agg(F.sum("explore").alias("explore"), F.sum("exploit").alias("exploit"), F.count("*").alias("turns"))
    rows = by.join(calls, "session_key")
    return rows.select(
        "session_key", "visits", "patches", "residence", (F.col("patches") / F.col("turns")).alias("efficiency"),
        F.coalesce(F.try_divide("explore", "exploit"), F.lit(0.0)).alias("explore_exploit"), ((F.col("visits") - F.col("patches")) / F.col("visits")).alias("revisit_rate"),
    )


def patch_table(visits: DataFrame) -> DataFrame:
    return visits.groupBy("patch").agg(F.count("*").alias("visits"), F.avg("residence").alias("mean_residence"))


@technique("information-foraging", needs=("messages", "tool_calls"))
def information_foraging(frames: Frames) -> TechniqueResult:
    """Patch foraging in directories.

    As published, the cohorts count every human class as a correction and the
    share of optimal departures is the constant 0.
    """
    turns = foraging_turns(frames)
    visits = patch_visits(turns)
    rows = foraging_sessions(turns, visits)
    human = frames.messages.where("role = 'User'").groupBy("session_key").agg((F.count_if(F.startswith("classification", F.lit("Human"))) / F.count("*")).alias("human"))
    rows = rows.join(human, "session_key", "left").na.fill(0.0, ["human"])
    low, high = F.col("human") <= 0.10, F.col("human") > 0.25
    row = rows.agg(
        F.avg("patches").alias("mean_patches_per_session"), F.avg("residence").alias("mean_residence_time"), F.avg("efficiency").alias("mean_foraging_efficiency"),
        F.avg("explore_exploit").alias("explore_exploit_ratio"), F.lit(0.0).alias("mvt_compliance_rate"), F.avg("revisit_rate").alias("patch_revisit_rate"),
        F.avg(F.when(low, F.col("residence"))).alias("low_correction_foraging_time"), F.avg(F.when(high, F.col("residence"))).alias("high_correction_foraging_time"),
    )
    names = ("patches", "residence", "efficiency", "explore_exploit", "revisit_rate")
    each = rows.agg(*(F.avg(c).alias(c) for c in names), *(F.avg(F.when(w, F.col(c))).alias(f"{c}_{t}") for c in names for t, w in (("low", low), ("high", high))))
    summary = each.select(F.inline(F.array(*(F.struct(F.lit(c).alias("Metric"), F.col(c).alias("Value")) for c in names))))
    compare = each.select(F.inline(F.array(*(F.struct(F.lit(c).alias("Metric"), F.col(f"{c}_low").alias("Low Correction (<=10%)"), F.col(f"{c}_high").alias("High Correction (>25%)")) for c in names))))
    patches = patch_table(visits).orderBy(F.desc("visits"), "patch").select(F.col("patch").alias("Patch"), F.col("visits").alias("Total Visits"), F.col("mean_residence").alias("Mean Residence Time"))
    return TechniqueResult("information_foraging", {"Foraging Metrics Summary": summary, "Success vs Struggle Comparison": compare, "Patch Analysis": patches}, findings_of("information_foraging", row))


# --- epistemic networks ---

EDGES = [(a, b) for i, a in enumerate(P.CODES) for b in P.CODES[i + 1 :]]


def code_columns(messages: DataFrame) -> DataFrame:
    """One 0/1 column for each code of a turn that is not the system's."""
    blob = F.concat_ws(" ", F.nullif("text", F.lit("")), F.nullif("thinking", F.lit("")))
    any_word = lambda words: blob.rlike(r"(?i)\b(" + "|".join(words) + r")\b")
    flags = {c: any_word(P.CODE_KEYWORDS[c]) if c in P.CODE_KEYWORDS else F.coalesce(F.col("n_tool_calls") > 0, F.lit(False)) for c in P.CODES}
    return messages.where("role <> 'System'").select("session_key", "msg_idx", *(f.cast("int").alias(c) for c, f in flags.items()))


def network_sessions(coded: DataFrame, window: int = 5, least: int = 3, full: bool = False) -> DataFrame:
    """Each session's edge weights: shares of turns whose last ``window`` turns have both codes.

    ``full`` counts only windows that have all their turns.
    """
    own = W.partitionBy("session_key")
    recent = own.orderBy("msg_idx").rowsBetween(1 - window, 0)
    rows = coded.select("session_key", F.count("*").over(own).alias("turns"), F.count("*").over(recent).alias("seen"), *(F.max(c).over(recent).alias(c) for c in P.CODES))
    rows = rows.where((F.col("turns") >= least) & (F.col("seen") >= (window if full else 1)))
    return rows.groupBy("session_key").agg(*(F.avg(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in EDGES))


def network_edges(sessions: DataFrame) -> DataFrame:
    """``code_a, code_b, weight``: the mean network, as rows."""
    row = sessions.agg(*(F.avg(f"`{a}|{b}`").alias(f"{a}|{b}") for a, b in EDGES))
    return row.select(F.inline(F.array(*(F.struct(F.lit(a).alias("code_a"), F.lit(b).alias("code_b"), F.coalesce(F.col(f"`{a}|{b}`"), F.lit(0.0)).alias("weight")) for a, b in EDGES))))


def network_centrality(edges: DataFrame) -> DataFrame:
    """Share of each code in the sum of edge ends."""
    ends = edges.select(F.col("code_a").alias("code"), "weight").unionByName(edges.select(F.col("code_b").alias("code"), "weight"))
    by = ends.groupBy("code").agg(F.sum("weight").alias("w"))
    return by.select("code", F.coalesce(F.try_divide("w", F.sum("w").over(W.partitionBy())), F.lit(0.0)).alias("centrality"))


@technique("ena-analysis", needs=("messages", "sessions"))
def ena_analysis(frames: Frames) -> TechniqueResult:
    """Epistemic network of codes that occur together within five turns."""
    from .process import cohorts

    coded = code_columns(frames.messages)
    sessions = network_sessions(coded)
    edges = network_edges(sessions)
    frequency = coded.agg(*(F.sum(c).alias(c) for c in P.CODES)).select(F.inline(F.array(*(F.struct(F.lit(c).alias("code"), F.col(c).alias("frequency")) for c in P.CODES))))
    centre = network_centrality(edges).join(frequency, "code")
    grouped = sessions.join(cohorts(frames).select("session_key", "cohort"), "session_key")
    low, high = (network_edges(grouped.where(F.col("cohort") == c)).withColumnRenamed("weight", f"{c}_correction_weight") for c in ("low", "high"))
    both = low.join(high, ["code_a", "code_b"]).withColumn("difference", F.col("low_correction_weight") - F.col("high_correction_weight"))
    top = both.orderBy(F.desc(F.abs("difference")), "code_a", "code_b").limit(10)
    name = F.concat_ws("-", "code_a", "code_b")
    row = centre.agg(F.min_by("code", F.struct(-F.col("centrality"), "code")).alias("top_code"), F.max("centrality").alias("top_code_centrality"))
    strong = both.agg(*(F.min_by(name, F.struct(-F.col(f"{c}_correction_weight"), name)).alias(f"strongest_{c}_correction_edge") for c in ("low", "high")))
    counted = sessions.agg(F.count("*").alias("sessions_analyzed"))
    return TechniqueResult("ena_analysis", {"Code Centrality": centre, "Discriminative Edges": top}, union(*(findings_of("ena_analysis", x) for x in (counted, row, strong))))


# --- user signals ---


def user_signals(messages: DataFrame) -> DataFrame:
    """Classified user messages: their categories and frustration; blank, boilerplate and other languages out."""
    clean = P.without_boilerplate(F.coalesce("text", F.lit("")))
    rows = messages.where("role = 'User'").withColumn("clean", clean).where("trim(text) <> ''")
    state = F.when(F.col("clean") == "", "boilerplate").when(~P.mostly_ascii(F.col("clean")), "other_language").otherwise("classified")
    low = F.lower("clean")
    flags = F.array_compact(F.array(*(F.when(P.any_of(low, p), c) for c, p in P.SIGNALS.items())))
    rows = rows.withColumn("state", state)
    ok = F.col("state") == "classified"
    rows = rows.select("session_key", "msg_idx", "state", F.when(ok, flags).alias("flags"), F.when(ok, P.frustration(F.col("clean"))).alias("score"))
    return rows.select("session_key", "msg_idx", "state", F.when(F.size("flags") == 0, F.array(F.lit("unclassified"))).otherwise(F.col("flags")).alias("categories"), "score")


def signal_counts(signals: DataFrame) -> DataFrame:
    """Messages of each category; shares may add up to more than 1."""
    names = [*P.SIGNALS, "unclassified"]
    row = signals.where("state = 'classified'").agg(F.count("*").alias("total"), *(F.count_if(F.array_contains("categories", c)).alias(c) for c in names))
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("count"), F.coalesce(F.try_divide(c, "total"), F.lit(0.0)).alias("pct_of_classified")) for c in names)))
    return row.select(each)


def frustration_histogram(signals: DataFrame) -> DataFrame:
    spine = signals.sparkSession.range(6).select(F.col("id").cast("int").alias("intensity"))
    counts = signals.where("state = 'classified'").groupBy(F.col("score").alias("intensity")).agg(F.count("*").alias("n"))
    return spine.join(counts, "intensity", "left").select("intensity", F.coalesce("n", F.lit(0)).alias("count"))


def escalations(signals: DataFrame) -> DataFrame:
    """Maximal runs of scores that never fall, of at least two messages and a peak of at least 2."""
    w = W.partitionBy("session_key").orderBy("msg_idx")
    rows = signals.where("state = 'classified'").withColumn("fall", F.coalesce((F.col("score") < F.lag("score").over(w)).cast("int"), F.lit(0)))
    rows = rows.withColumn("run", F.sum("fall").over(w))
    by = rows.groupBy("session_key", "run").agg(F.min("msg_idx").alias("start_index"), F.count("*").alias("length"), F.max("score").alias("peak_intensity"))
    return by.where("length >= 2 and peak_intensity >= 2").select(F.col("session_key").alias("session_id"), "start_index", "length", "peak_intensity")


@technique("user-signal-analysis", needs=("messages", "sessions"))
def user_signal_analysis(frames: Frames) -> TechniqueResult:
    """Categories, frustration and escalations of user messages."""
    signals = user_signals(frames.messages)
    counts, chains = signal_counts(signals), escalations(signals)
    kind = F.col("state")
    sizes = signals.agg(F.count("*").alias("total_user_messages"), F.count_if(kind == "classified").alias("messages_classified"), F.count_if(kind == "other_language").alias("skipped_non_english_messages"), F.count_if(kind == "boilerplate").alias("boilerplate_messages"))
    each = counts.groupBy().pivot("category", list(P.SIGNALS)).agg(F.first("count")).withColumnsRenamed({c: f"{c}s" for c in P.SIGNALS})
    found = chains.agg(F.count("*").alias("escalations_found"))
    peak = signals.where("score > 0").join(frames.sessions.select("session_key", "session_ord", "session_id"), "session_key")
    peak = peak.agg(F.min_by("session_id", F.struct(-F.col("score"), "session_ord", "msg_idx")).alias("peak_frustration_session_id"))
    top = chains.orderBy(F.desc("peak_intensity"), F.desc("length"), "session_id", "start_index").limit(20)
    tables = {"Category Counts": counts, "Frustration Distribution": frustration_histogram(signals), "Escalation Sequences": top}
    return TechniqueResult("user-signal-analysis", tables, union(*(findings_of("user-signal-analysis", x) for x in (sizes, each, found, peak))))


# --- scored classes and merged turns ---


def class_scores(text) -> dict:
    """Likelihoods of four classes from the number of patterns that match; long texts are hardly corrections."""
    low, size = F.lower(text), F.length(text)
    hits = lambda name: sum((F.when(low.rlike(p), 1).otherwise(0) for p in P.SIGNALS[name]), F.lit(0))
    k, q = hits("correction"), hits("question")
    base = F.least(F.lit(0.95), 0.6 + 0.15 * (k - 1))
    fade = F.when(size > 300, F.greatest(F.lit(0.5), 1 - (size - 300) / 1400)).otherwise(1.0)
    return {
        "correction": F.when(k > 0, base * fade).otherwise(0.0),
        "approval": F.when(hits("approval") > 0, 0.85).otherwise(0.0),
        "question": F.when(q >= 2, 0.8).when((q == 1) & low.rlike(r"\?$"), 0.7).when(q == 1, 0.5).otherwise(0.0),
        "directive": F.when(hits("directive") > 0, 0.7).otherwise(0.0),
    }


def scored_messages(messages: DataFrame) -> DataFrame:
    """User messages with the scores and the best class (the earlier one on ties, ``none`` where all are 0)."""
    text = P.trimmed(F.coalesce("text", F.lit("")))
    rows = messages.where("role = 'User'").select("session_key", "msg_idx", *(c.alias(n) for n, c in class_scores(text).items()))
    best = F.greatest(*map(F.col, ("correction", "approval", "question", "directive")))
    pick = F
    for n in ("correction", "approval", "question", "directive"):
        pick = pick.when((best > 0) & (F.col(n) == best), n)
    return rows.withColumn("best", pick.otherwise("none"))


# Words that mark a stance in thinking.
MARKERS = {
    "uncertainty": ("maybe", "perhaps", "might", "unclear", "not sure", "uncertain"),
    "confidence": ("definitely", "certainly", "clearly", "obviously", "sure"),
    "plan": ("plan", "first", "then", "next", "step", "finally"),
    "risk": ("risk", "danger", "careful", "warning", "break", "unsafe"),
    "tool_doubt": ("tool failed", "did not work", "didn't work", "unexpected output"),
}


def merged_turns(messages: DataFrame) -> DataFrame:
    """Consecutive assistant messages as one turn: lengths, marker counts in thinking, and whether a correction follows."""
    w = W.partitionBy("session_key").orderBy("msg_idx")
    rows = runs(messages.where("role in ('User', 'Assistant')"), ["session_key"], ["msg_idx"], ["role"])
    rows = rows.withColumn("next", F.lead("classification").over(w))
    by = rows.where("role = 'Assistant'").groupBy("session_key", "run").agg(
        F.min("msg_idx").alias("first_idx"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", F.coalesce("thinking", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("thinking"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("text_len"), F.max_by("next", "msg_idx").alias("next"),
    )
    count = lambda words: F.regexp_count(F.lower("thinking"), F.lit(r"\b(" + "|".join(words) + r")\b"))
    return by.select("session_key", "first_idx", F.length("thinking").alias("thinking_len"), "text_len", *(count(v).alias(k) for k, v in MARKERS.items()), F.coalesce(F.col("next") == "HumanCorrection", F.lit(False)).alias("corrected"))
