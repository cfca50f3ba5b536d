"""Process graphs, lag statistics, sequential patterns and excitation on event sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import Frames
from ..operators.ordered import bigrams, runs
from ..result import TechniqueResult, findings_from_rows, findings_of, technique, union

# --- process mining ---

ACTIVITY_OF_CLASS = {
    "HumanCorrection": "user_correction", "HumanDirective": "user_request", "HumanApproval": "user_approval", "HumanQuestion": "user_question",
    "SystemMessage": "system_message", "Other": "other", "Unclassified": "unclassified",
}


def activities(frames: Frames, intended: bool = False) -> DataFrame:
    """``session_key, pos, symbol``: the activity log of each session.

    As published, tool names were looked up under a key that the data model does
    not have, so assistant messages come out as their class.  ``intended`` uses
    the tools instead.
    """
    klass = F.coalesce("classification", F.lit("Unclassified"))
    base = F
    for name, activity in ACTIVITY_OF_CLASS.items():
        base = base.when(klass == name, activity)
    base = base.otherwise("other")
    order = W.partitionBy("session_key").orderBy("msg_idx", "call_idx")
    if not intended:
        return frames.messages.select("session_key", F.row_number().over(W.partitionBy("session_key").orderBy("msg_idx")).alias("pos"), base.alias("symbol"))
    low = F.lower("name")
    tool = F.when(low.isin("read", "glob", "grep"), "search_code").when(low.isin("edit", "write"), "edit_file").when(low.isin("bash", "skill"), "run_command").when(low != "", "other_tool")
    called = frames.tool_calls.select("session_key", "msg_idx", "call_idx", tool.alias("tool")).where("tool is not null")
    rows = frames.messages.join(called, ["session_key", "msg_idx"], "left")
    symbol = F.coalesce("tool", F.when(F.col("role") == "Assistant", "assistant_text").otherwise(base))
    return rows.select("session_key", F.row_number().over(order).alias("pos"), symbol.alias("symbol"))


def event_log(calls: DataFrame) -> DataFrame:
    return calls.select("session_key", "pos", F.col("name").alias("symbol"))


def directly_follows(log: DataFrame) -> DataFrame:
    return bigrams(log, ["session_key"], ["pos"], "symbol").groupBy(F.col("from").alias("source"), F.col("to").alias("target")).agg(F.count("*").alias("n"))


def activity_stats(log: DataFrame) -> DataFrame:
    """Frequency, share of sessions and mean run length of each activity."""
    sessions = log.agg(F.count_distinct("session_key").alias("all"))
    run = runs(log, ["session_key"], ["pos"], ["symbol"])
    by = run.groupBy("symbol", "session_key").agg(F.count("*").alias("n"), F.count_distinct("run").alias("runs"))
    by = by.groupBy("symbol").agg(F.sum("n").alias("frequency"), F.count("*").alias("sessions"), F.sum("runs").alias("runs"))
    return by.join(F.broadcast(sessions)).select("symbol", "frequency", (100.0 * F.col("sessions") / F.col("all")).alias("coverage_pct"), (F.col("frequency") / F.col("runs")).alias("mean_dwell"))


def predecessors(log: DataFrame, symbol: str) -> DataFrame:
    return directly_follows(log).where(F.col("target") == symbol).select(F.col("source").alias("activity"), "n")


def variants(log: DataFrame) -> DataFrame:
    """Distinct sequences with runs collapsed and how many sessions follow each."""
    run = runs(log, ["session_key"], ["pos"], ["symbol"]).groupBy("session_key", "run").agg(F.first("symbol").alias("symbol"))
    path = run.groupBy("session_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "symbol"))), lambda x: x["symbol"]), ">").alias("variant"))
    return path.groupBy("variant").agg(F.count("*").alias("sessions"))


@technique("process-mining", needs=("messages", "tool_calls"))
def process_mining(frames: Frames, intended: bool = False) -> TechniqueResult:
    """Directly-follows graph and activity statistics."""
    log = activities(frames, intended)
    stats, graph = activity_stats(log), directly_follows(log)
    before = predecessors(log, "user_correction")
    loops = graph.where("source = target")
    row = stats.agg(F.coalesce(F.sum("frequency"), F.lit(0)).alias("total_events"), F.count("*").alias("unique_activities"), F.min_by("symbol", F.struct(-F.col("frequency"), "symbol")).alias("most_common_activity"))
    rework = loops.agg(F.min_by("source", F.struct(-F.col("n"), "source")).alias("top_rework_activity"))
    first = before.agg(F.min_by("activity", F.struct(-F.col("n"), "activity")).alias("top_correction_predecessor"))
    edges = graph.agg(F.count("*").alias("dfg_edges"))
    tables = {
        "Activity Frequencies": stats.select(F.col("symbol").alias("Activity"), F.col("frequency").alias("Frequency"), F.col("coverage_pct").alias("Session Coverage (%)"), F.col("mean_dwell").alias("Mean Dwell Time")),
        "Directly-Follows Graph": graph.select(F.col("source").alias("Source"), F.col("target").alias("Target"), F.col("n").alias("Count")),
        "Correction Predecessors": before.select(F.col("activity").alias("Activity"), F.col("n").alias("Count")),
    }
    return TechniqueResult("process_mining", tables, union(*(findings_of("process_mining", x) for x in (row, rework, first, edges))))


# --- lag-sequential analysis ---

EVENT_CODES = ("UR", "UC", "UA", "UQ", "AF", "AK", "AR", "AE", "AB", "AS", "AT")


def coded_events(frames: Frames) -> DataFrame:
    """One code for each message that is not the system's."""
    failed = frames.tool_results.groupBy("session_key", "msg_idx").agg(F.bool_or(F.coalesce("is_error", F.lit(False))).alias("failed"))
    tools = frames.tool_calls.groupBy("session_key", "msg_idx").agg(F.collect_set("name").alias("tools"))
    rows = frames.messages.where("role <> 'System'").join(failed, ["session_key", "msg_idx"], "left").join(tools, ["session_key", "msg_idx"], "left")
    has = lambda *names: F.coalesce(F.arrays_overlap("tools", F.array(*map(F.lit, names))), F.lit(False))
    klass = F.col("classification")
    user = F.when(klass == "HumanCorrection", "UC").when(klass == "HumanApproval", "UA").when(klass == "HumanQuestion", "UQ").otherwise("UR")
    agent = (
        F.when(F.coalesce("failed", F.lit(False)), "AF").when(F.coalesce(F.length("thinking"), F.lit(0)) > 0, "AK").when(has("Read", "Glob", "Grep"), "AR")
        .when(has("Edit", "Write", "NotebookEdit"), "AE").when(has("Bash"), "AB").when(has("Skill"), "AS").otherwise("AT")
    )
    code = F.when(F.col("role") == "User", user).otherwise(agent)
    return rows.select("session_key", F.col("msg_idx").alias("pos"), code.alias("symbol"))


def long_enough(log: DataFrame, least: int) -> DataFrame:
    n = F.count("*").over(W.partitionBy("session_key"))
    return log.withColumn("__n", n).where(F.col("__n") >= least).drop("__n")


def lag_residuals(log: DataFrame, lags: int = 3) -> DataFrame:
    """Adjusted residuals of every pair of codes at each lag, also of pairs that never occur."""
    w = W.partitionBy("session_key").orderBy("pos")
    ahead = log.select(F.col("symbol").alias("from"), F.array(*(F.struct(F.lit(k).alias("lag"), F.lead("symbol", k).over(w).alias("to")) for k in range(1, lags + 1))).alias("ahead"))
    pairs = ahead.select("from", F.inline("ahead"))
    seen = pairs.where("`to` is not null").groupBy("lag", "from", "to").agg(F.count("*").alias("observed"))
    row = seen.groupBy("lag", "from").agg(F.sum("observed").alias("r"))
    column = seen.groupBy("lag", "to").agg(F.sum("observed").alias("c"))
    # The alphabet's square: a few hundred rows.
    cells = row.join(column, "lag").join(seen, ["lag", "from", "to"], "left").na.fill(0, ["observed"])
    n = F.sum("observed").over(W.partitionBy("lag"))
    cells = cells.withColumn("n", n).withColumn("expected", F.col("r") * F.col("c") / F.col("n"))
    below = F.col("expected") * (1 - F.col("r") / F.col("n")) * (1 - F.col("c") / F.col("n"))
    z = F.when(below > 1e-12, (F.col("observed") - F.col("expected")) / F.sqrt(below)).otherwise(0.0)
    return cells.select("from", "to", "lag", "observed", "expected", z.alias("z_score"))


def event_frequencies(log: DataFrame) -> DataFrame:
    counts = log.groupBy(F.col("symbol").alias("event")).agg(F.count("*").alias("count"))
    return counts.withColumn("proportion", F.col("count") / F.sum("count").over(W.partitionBy()))


def top_residuals(cells: DataFrame, positive: bool, k: int) -> DataFrame:
    side = cells.where("z_score > 1e-4" if positive else "z_score < -1e-4")
    return side.orderBy(F.desc("z_score") if positive else F.asc("z_score"), "lag", "from", "to").limit(k)


@technique("lag-sequential", needs=("messages", "tool_calls", "tool_results"))
def lag_sequential(frames: Frames) -> TechniqueResult:
    """Lag-sequential transitions with adjusted residuals."""
    log = long_enough(coded_events(frames), 20)
    cells = lag_residuals(log)
    positive, negative = top_residuals(cells, True, 20), top_residuals(cells, False, 10)
    row = log.agg(F.count("*").alias("total_events"), F.count_distinct("session_key").alias("sessions_analyzed"))
    strong = cells.agg(*(F.count_if((F.col("lag") == k) & (F.abs("z_score") >= 2.58)).alias(f"significant_transitions_lag{k}") for k in (1, 2, 3)))
    name = F.concat_ws("->", "from", "to")
    best = cells.agg(F.max_by(name, F.struct("z_score", name)).alias("top_positive_transition"), F.min_by(name, F.struct("z_score", name)).alias("top_negative_transition"))
    tables = {"Top Positive Transitions": positive, "Top Negative Transitions": negative, "Event Frequencies": event_frequencies(log)}
    return TechniqueResult("lag_sequential", tables, union(*(findings_of("lag_sequential", x) for x in (row, strong, best))))


# --- sequential patterns ---


def ngram_support(log: DataFrame, n: int) -> DataFrame:
    """Contiguous n-grams: occurrences and sessions."""
    w = W.partitionBy("session_key").orderBy("pos")
    parts = [F.col("symbol"), *(F.lead("symbol", k).over(w) for k in range(1, n))]
    rows = log.select("session_key", F.array(*parts).alias("p")).where(F.get("p", F.lit(n - 1)).isNotNull())
    by = rows.groupBy(F.array_join("p", ">").alias("pattern"), "session_key").agg(F.count("*").alias("n"))
    return by.groupBy("pattern").agg(F.sum("n").alias("occurrences"), F.count("*").alias("sessions"))


def frequent_patterns(log: DataFrame, share: float = 0.15, longest: int = 6, top: int = 200, shortest: int = 3) -> DataFrame:
    """Gapped frequent subsequences: the ``top`` by support over all lengths, then those of the wanted lengths."""
    from pyspark.ml.fpm import PrefixSpan

    paths = log.groupBy("session_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: F.array(x["symbol"])).alias("sequence"))
    n = paths.count()
    if not n:
        return log.sparkSession.createDataFrame([], "pattern string, length int, support bigint, support_pct double")
    least = max(2, int(share * n))
    found = PrefixSpan(minSupport=least / n, maxPatternLength=longest, maxLocalProjDBSize=32_000_000).findFrequentSequentialPatterns(paths.select("sequence"))
    flat = found.select(F.array_join(F.flatten("sequence"), ">").alias("pattern"), F.size("sequence").alias("length"), F.col("freq").alias("support"))
    flat = flat.where(F.col("support") >= least).orderBy(F.desc("support"), "length", "pattern").limit(top)
    return flat.where(F.col("length").between(shortest, longest)).withColumn("support_pct", 100.0 * F.col("support") / n)


def cohorts(frames: Frames) -> DataFrame:
    """``session_key, rate, cohort``: low (<= 0.10) or high (> 0.25) share of corrections among user messages."""
    user = frames.messages.where("role = 'User'").groupBy("session_key").agg(F.count("*").alias("n"), F.count_if(F.col("classification") == "HumanCorrection").alias("c"))
    rate = F.coalesce(F.try_divide("c", "n"), F.lit(0.0))
    rows = frames.sessions.select("session_key").join(user, "session_key", "left").withColumn("rate", rate)
    return rows.select("session_key", "rate", F.when(F.col("rate") <= 0.10, "low").when(F.col("rate") > 0.25, "high").alias("cohort"))


@technique("prefixspan-mining", needs=("sessions", "messages", "tool_calls"))
def prefixspan_mining(frames: Frames) -> TechniqueResult:
    """Frequent sequential patterns of tools and what tells the cohorts apart."""
    calls = frames.tool_calls.join(frames.messages.where("role = 'Assistant'").select("session_key", "msg_idx"), ["session_key", "msg_idx"], "left_semi")
    log = event_log(calls)
    found = frequent_patterns(log)
    cohort = cohorts(frames)
    path = log.groupBy("session_key").agg(F.concat(F.lit(">"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), ">"), F.lit(">")).alias("path"))
    # At most 200 patterns are searched in every path.
    hits = path.join(cohort.where("cohort is not null"), "session_key").join(F.broadcast(found.select("pattern")), F.expr("instr(path, concat('>', pattern, '>')) > 0"))
    both = hits.groupBy("pattern").pivot("cohort", ["low", "high"]).agg(F.count(F.lit(1))).na.fill(0)
    high, low = F.col("high"), F.col("low")
    told = both.select("pattern", F.when(low > 2 * high, "low_correction").when(high > 2 * low, "high_correction").alias("group"), F.when(low > 2 * high, F.try_divide(low, high)).when(high > 2 * low, F.try_divide(high, low)).alias("support_ratio")).where("group is not null")
    sizes = cohort.agg(F.count("*").alias("total_sessions"), F.count_if(F.col("cohort") == "low").alias("low_correction_sessions"), F.count_if(F.col("cohort") == "high").alias("high_correction_sessions"))
    counts = found.agg(F.count("*").alias("total_patterns"), *(F.count_if(F.col("length") == k).alias(f"patterns_length_{k}") for k in range(3, 7)))
    groups = told.agg(F.count_if(F.col("group") == "low_correction").alias("success_patterns"), F.count_if(F.col("group") == "high_correction").alias("struggle_patterns"))
    with_tools = path.agg(F.count("*").alias("sequences_with_tools"), F.greatest(F.lit(2), F.floor(0.15 * F.count("*"))).alias("min_support_threshold"))
    tables = {"Frequent Sequential Patterns": found.orderBy(F.desc("support"), "length", "pattern").limit(50), "Discriminative Patterns": told}
    return TechniqueResult("prefixspan_mining", tables, union(*(findings_of("prefixspan_mining", x) for x in (sizes, with_tools, counts, groups))))


# --- symbol strings and k-mers ---


def symbol_strings(log: DataFrame, alphabet: dict[str, str], other: str = "X") -> DataFrame:
    """``session_key, s``: each sequence as one string of one-character symbols."""
    code = F
    for name, letter in alphabet.items():
        code = code.when(F.col("symbol") == name, letter)
    ordered = F.array_sort(F.collect_list(F.struct("pos", code.otherwise(other).alias("c"))))
    return log.groupBy("session_key").agg(F.array_join(F.transform(ordered, lambda x: x["c"]), "").alias("s"))


def kmers(strings: DataFrame, sizes=(3, 4, 5)) -> DataFrame:
    """``session_key, kmer``: every k-mer of every string."""
    part = lambda k: lambda i: F.col("s").substr(i, F.lit(k))
    each = F.flatten(F.array(*(F.when(F.length("s") >= k, F.transform(F.sequence(F.lit(1), F.length("s") - k + 1), part(k))).otherwise(F.array().cast("array<string>")) for k in sizes)))
    return strings.select("session_key", F.explode(each).alias("kmer"))


def conserved_kmers(strings: DataFrame, share: float = 0.3) -> DataFrame:
    """K-mers in more than a share of the sessions."""
    n = strings.count()
    by = kmers(strings).groupBy("kmer", "session_key").agg(F.count("*").alias("n")).groupBy("kmer").agg(F.sum("n").alias("frequency"), F.count("*").alias("sessions"))
    return by.where(F.col("sessions") > share * n).select(F.col("kmer").alias("motif"), "frequency", (100.0 * F.col("sessions") / n).alias("session_coverage_pct"))


def kmer_enrichment(strings: DataFrame, groups: DataFrame) -> DataFrame:
    """Non-overlapping frequency a symbol of every conserved k-mer in the two groups (``session_key, high``)."""
    motifs = conserved_kmers(strings).select("motif")
    times = (F.length("s") - F.length(F.replace("s", F.col("motif")))) / F.length("motif")
    rows = strings.join(groups, "session_key").join(F.broadcast(motifs))  # k-mers of a small alphabet
    by = rows.groupBy("motif").agg(
        *((F.sum(F.when(F.col("high") == h, times)) / F.sum(F.when(F.col("high") == h, F.length("s")))).alias(name) for name, h in (("low_freq", False), ("high_freq", True)))
    )
    ratio = F.try_divide("high_freq", "low_freq")
    return by.where("low_freq > 0 and high_freq > 0").select("motif", "low_freq", "high_freq", ratio.alias("enrichment_ratio"))


def kmer_presence(strings: DataFrame, groups: DataFrame) -> DataFrame:
    """``motif, a, b, c, d``: high sessions with and without each conserved k-mer, low ones with and without."""
    motifs = conserved_kmers(strings).select("motif")
    sizes = groups.join(strings.select("session_key"), "session_key").agg(F.count_if("high").alias("highs"), F.count_if(~F.col("high")).alias("lows"))
    seen = kmers(strings).select(F.col("kmer").alias("motif"), "session_key").distinct().join(F.broadcast(motifs), "motif").join(groups, "session_key")  # k-mers of a small alphabet
    by = seen.groupBy("motif").agg(F.count_if("high").alias("a"), F.count_if(~F.col("high")).alias("c")).crossJoin(F.broadcast(sizes))
    return by.select("motif", "a", (F.col("highs") - F.col("a")).alias("b"), "c", (F.col("lows") - F.col("c")).alias("d"))


# --- excitation, lifetimes, as-of ---


def excitation(log: DataFrame, windows=(3, 5, 10), least: int = 5) -> DataFrame:
    """Responses within the next w events of a trigger against the rate over all full windows.

    Triggers need a full window after them and must be more than ``least``.
    """
    out = None
    for width in windows:
        ahead = W.partitionBy("session_key").orderBy("pos").rowsBetween(1, width)
        rows = log.select(F.col("symbol").alias("trigger"), F.collect_list("symbol").over(ahead).alias("next")).where(F.size("next") == width)
        seen = rows.select("trigger", F.explode("next").alias("response")).groupBy("trigger", "response").agg(F.count("*").alias("n"))
        triggers = rows.groupBy("trigger").agg(F.count("*").alias("triggers"))
        base = seen.groupBy("response").agg(F.sum("n").alias("base_n"))
        total = triggers.agg(F.sum("triggers").alias("all"))
        both = seen.join(triggers.where(F.col("triggers") > least), "trigger").join(base, "response").join(F.broadcast(total))
        both = both.select("trigger", "response", F.lit(width).alias("window"), "triggers", "n", (F.col("n") / F.col("triggers") / (F.col("base_n") / F.col("all"))).alias("excitation"))
        out = both if out is None else out.unionByName(both)
    return out


def decay(log: DataFrame, symbol: str, lags: int = 20) -> DataFrame:
    """Rate of ``symbol`` at each lag after an occurrence of it, and overall."""
    w = W.partitionBy("session_key").orderBy("pos")
    hit = (F.col("symbol") == symbol).cast("int")
    ahead = log.select(hit.alias("hit"), F.array(*(F.struct(F.lit(k).alias("lag"), F.lead(hit, k).over(w).alias("later")) for k in range(1, lags + 1))).alias("ahead"))
    rows = ahead.where("hit = 1").select(F.inline("ahead"))
    base = log.agg(F.avg(hit).alias("baseline"))
    return rows.where("later is not null").groupBy("lag").agg(F.count("*").alias("n"), F.avg("later").alias("rate")).join(F.broadcast(base))


def cascades(log: DataFrame, symbol: str, gap: int, least: int = 2) -> DataFrame:
    """Maximal chains of ``symbol`` whose consecutive places differ by at most ``gap``."""
    w = W.partitionBy("session_key").orderBy("pos")
    rows = log.where(F.col("symbol") == symbol).withColumn("new", (F.coalesce(F.col("pos") - F.lag("pos").over(w), F.lit(gap + 1)) > gap).cast("int"))
    rows = rows.withColumn("chain", F.sum("new").over(w))
    return rows.groupBy("session_key", "chain").agg(F.count("*").alias("length"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")).where(F.col("length") >= least)


def lifetime_deciles(log: DataFrame) -> DataFrame:
    """Counts of each symbol in the tenths of its session."""
    own = W.partitionBy("session_key")
    place = F.row_number().over(own.orderBy("pos")) - 1
    rows = log.select("symbol", F.floor(place * 10 / F.count("*").over(own)).cast("int").alias("decile"))
    return rows.groupBy("decile", "symbol").agg(F.count("*").alias("n"))


def next_after(log: DataFrame, first: str, then: str) -> DataFrame:
    """As-of join: for each ``first`` the next ``then`` of its session, and the time between in seconds."""
    later = W.partitionBy("session_key").orderBy("pos").rowsBetween(1, W.unboundedFollowing)
    at = F.first(F.when(F.col("symbol") == then, F.col("ts")), True).over(later)
    rows = log.select("session_key", "pos", "symbol", "ts", at.alias("next_ts")).where(F.col("symbol") == first)
    wait = (F.unix_micros("next_ts") - F.unix_micros("ts")) / 1e6
    return rows.select("session_key", "pos", wait.alias("wait_s"))


def critical_interval(waits: DataFrame) -> DataFrame:
    """Quartiles of the waits: the interval that a time pattern is tested on."""
    q = lambda p: F.percentile("wait_s", F.lit(p))
    return waits.agg(F.count("wait_s").alias("n"), q(0.25).alias("d1"), q(0.75).alias("d2"))


def beta_diversity(counts: DataFrame) -> DataFrame:
    """Jaccard and Bray-Curtis distance of every two groups of ``group, symbol, n``.

    The table has groups times symbols rows; pairs of groups are its output.
    """
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("group")))
    sizes = p.groupBy("group").agg(F.count("*").alias("s"))
    a, b = p.select(F.col("group").alias("a"), "symbol", F.col("p").alias("pa")), p.select(F.col("group").alias("b"), "symbol", F.col("p").alias("pb"))
    common = a.join(b, "symbol").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"), F.sum(F.least("pa", "pb")).alias("overlap"))
    ga, gb = sizes.select(F.col("group").alias("a"), F.col("s").alias("sa")), sizes.select(F.col("group").alias("b"), F.col("s").alias("sb"))
    pairs = ga.join(gb, F.col("a") < F.col("b")).join(common, ["a", "b"], "left").na.fill(0, ["both", "overlap"])
    return pairs.select("a", "b", (1 - F.col("both") / (F.col("sa") + F.col("sb") - F.col("both"))).alias("jaccard"), (1 - F.col("overlap")).alias("bray_curtis"))


# --- T-patterns ---


def pattern_codes(frames: Frames, intended: bool = False) -> DataFrame:
    """Nine-letter event codes; as published every tool call is ``AT`` (see :func:`activities`)."""
    failed = frames.tool_results.groupBy("session_key", "msg_idx").agg(F.bool_or(F.coalesce("is_error", F.lit(False))).alias("failed"))
    rows = frames.messages.where("role in ('User', 'Assistant')").join(failed, ["session_key", "msg_idx"], "left")
    rows = rows.join(frames.tool_calls.select("session_key", "msg_idx", "call_idx", F.lower("name").alias("tool")), ["session_key", "msg_idx"], "left")
    whole = F.coalesce("failed", F.lit(False)) | (F.coalesce(F.length("thinking"), F.lit(0)) > 0) | (F.col("role") == "User")
    rows = rows.where(~whole | F.coalesce(F.col("call_idx") == 0, F.lit(True)))
    klass = F.col("classification")
    tool = F.lit("AT")
    if intended:
        tool = F.when(F.col("tool").isin("read", "glob", "grep"), "AR").when(F.col("tool").isin("edit", "write"), "AE").when(F.col("tool") == "bash", "AB").otherwise("AT")
    code = (
        F.when(F.col("role") == "User", F.when(klass == "HumanCorrection", "UC").when(klass == "HumanApproval", "UA").otherwise("UR"))
        .when(F.coalesce("failed", F.lit(False)), "AF").when(F.coalesce(F.length("thinking"), F.lit(0)) > 0, "AK").otherwise(tool)
    )
    return rows.select("session_key", F.row_number().over(W.partitionBy("session_key").orderBy("msg_idx", "call_idx")).alias("pos"), code.alias("symbol"))


# --- further sequence statistics ---


def order_entropy(log: DataFrame, orders=(1, 2, 3)) -> DataFrame:
    """``k, entropy``: entropy of the next symbol given the k before it, over all sessions; k = 0 is the marginal one."""
    w = W.partitionBy("session_key").orderBy("pos")
    out = None
    for k in (0, *orders):
        context = F.concat_ws(">", *(F.lag("symbol", j).over(w) for j in range(k, 0, -1))) if k else F.lit("")
        rows = log.select(context.alias("c"), F.col("symbol"), (F.lag("symbol", k).over(w).isNotNull() if k else F.lit(True)).alias("full")).where("full")
        cells = rows.groupBy("c", "symbol").agg(F.count("*").alias("n"))
        total = F.sum("n").over(W.partitionBy("c"))
        one = cells.select("n", total.alias("r")).agg((-F.sum(F.col("n") * F.log2(F.col("n") / F.col("r"))) / F.sum("n")).alias("entropy")).select(F.lit(k).alias("k"), "entropy")
        out = one if out is None else out.unionByName(one)
    return out


def edge_symbols(log: DataFrame, width: int = 5) -> DataFrame:
    """Counts of symbols among the first and the last ``width`` places of the sessions."""
    own = W.partitionBy("session_key")
    place, back = F.row_number().over(own.orderBy("pos")), F.row_number().over(own.orderBy(F.desc("pos")))
    rows = log.select("symbol", place.alias("i"), back.alias("j"))
    return rows.groupBy("symbol").agg(F.count_if(F.col("i") <= width).alias("first_n"), F.count_if(F.col("j") <= width).alias("last_n"))


def visit_gains(turns: DataFrame) -> DataFrame:
    """Marginal-value measures of patch visits: gain (exploiting turns), first-half and second-half gain, giving-up time.

    A visit gives up after its last gain; a patch is left optimally when the
    second half gains less than the first.
    """
    from ..operators.ordered import runs

    rows = runs(turns, ["session_key"], ["turn"], ["patch"]).where("patch is not null")
    own = W.partitionBy("session_key", "run")
    i, n = F.row_number().over(own.orderBy("turn")), F.count("*").over(own)
    rows = rows.select("session_key", "run", "patch", "exploit", i.alias("i"), n.alias("n"))
    half = F.col("i") * 2 <= F.col("n")
    return rows.groupBy("session_key", "run", "patch").agg(
        F.max("n").alias("residence"), F.sum("exploit").alias("gain"), F.sum(F.when(half, F.col("exploit")).otherwise(0)).alias("first_gain"),
        F.sum(F.when(~half, F.col("exploit")).otherwise(0)).alias("second_gain"), (F.max("n") - F.coalesce(F.max(F.when(F.col("exploit") > 0, F.col("i"))), F.lit(0))).alias("giving_up"),
    )


def mvt_test(visits: DataFrame) -> DataFrame:
    """Correlation of residence and gain, share of visits left with falling gain, mean giving-up time."""
    spread = F.stddev_pop("residence") * F.stddev_pop("gain")
    return visits.agg(
        F.count("*").alias("visits"), F.try_divide(F.covar_pop("residence", "gain"), spread).alias("residence_gain_r"),
        F.avg((F.col("second_gain") < F.col("first_gain")).cast("double")).alias("mvt_share"), F.avg("giving_up").alias("giving_up_time"),
    )
