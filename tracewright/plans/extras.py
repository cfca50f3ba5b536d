"""Further operators of the exploratory kind: project identity, conformance, success, maturity, hazard shape, exact tests.

Each takes plain frames (sessions keyed by ``session_key``, ordered by ``pos``) and
returns a lazy DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import trends

# Folders inside a repository, which do not name it.
INSIDE_REPOSITORY = (
    "src", "lib", "pkg", "pkgs", "crates", "packages", "test", "tests", "spec", "specs", "__tests__", "docs", "doc", "documentation",
    "examples", "example", "sample", "samples", "demo", "demos", "scripts", "tools", "bin", "utils", "internal", "cmd",
    "build", "dist", "out", "target", "node_modules", "vendor",
)


def project_id(cwd: Column) -> Column:
    """Opaque id of the project of a working folder; null where there is none.

    Home folders and trailing folders that lie inside a repository do not count,
    and the last two that remain are hashed.
    """
    local = F.regexp_replace(cwd, "^/(Users|home)/[^/]*", "")
    parts = F.filter(F.split(local, "/"), lambda x: x != "")
    named = F.transform(parts, lambda x, i: F.when(~F.lower(x).isin(*INSIDE_REPOSITORY), i + 1))
    kept = F.slice(parts, 1, F.coalesce(F.array_max(named), F.lit(0)))
    last = F.slice(kept, F.greatest(F.size(kept) - 1, F.lit(1)), 2)
    found = F.when(F.size(kept) == 0, "project_root").otherwise(F.concat(F.lit("project_"), F.substring(F.sha1(F.array_join(last, "/")), 1, 8)))
    return F.when(cwd != "", found)


# --- conformance ---


def ideal_conformance(log: DataFrame, ideal: list[str]) -> DataFrame:
    """``length, sessions, share``: how many sessions contain each prefix of an ideal sequence, in order, with gaps.

    The earliest match is greedy, so a session is one pass over its symbols; runs
    are collapsed first, which does not change what a sequence without immediate
    repetition matches.
    """
    w = W.partitionBy("session_key").orderBy("pos")
    rows = log.where(F.col("symbol").isin(*ideal)).withColumn("before", F.lag("symbol").over(w)).where("not (symbol <=> before)")
    path = F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"])
    wanted = F.array(*map(F.lit, ideal))
    matched = F.aggregate(path, F.lit(0), lambda done, x: F.when(F.get(wanted, done) == x, done + 1).otherwise(done))
    each = rows.groupBy("session_key").agg(matched.alias("matched"))
    steps = log.sparkSession.range(1, len(ideal) + 1).select(F.col("id").alias("length"))
    total = log.agg(F.count_distinct("session_key").alias("total"))
    counts = each.groupBy("matched").agg(F.count("*").alias("n"))  # at most one row a length
    found = steps.join(F.broadcast(counts), F.col("matched") >= F.col("length"), "left").groupBy("length").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sessions"))
    return found.crossJoin(F.broadcast(total)).select("length", "sessions", F.coalesce(F.try_divide("sessions", "total"), F.lit(0.0)).alias("share"))


# --- success ---


def success_scores(messages: DataFrame, commands: DataFrame) -> DataFrame:
    """``session_key, corrections, final, commits, score``: mood of the last telling user message, corrections and commits.

    ``commands`` is ``session_key, command`` of shell calls.  An approval at the end
    gives 2, a correction takes 2, corrections take three times their share, and
    a commit gives 1.
    """
    user = messages.where("role = 'User'")
    mood = F.when(F.col("classification") == "HumanApproval", "positive").when(F.col("classification") == "HumanCorrection", "correction")
    by = user.groupBy("session_key").agg(
        F.count("*").alias("n"), F.count_if(F.col("classification") == "HumanCorrection").alias("corrections"), F.max_by(mood, F.when(mood.isNotNull(), F.col("msg_idx"))).alias("final")
    )
    made = commands.groupBy("session_key").agg(F.count_if(F.contains("command", F.lit("git commit"))).alias("commits"))
    rows = by.join(made, "session_key", "left").select("session_key", "n", "corrections", F.coalesce("final", F.lit("neutral")).alias("final"), F.coalesce("commits", F.lit(0)).alias("commits"))
    end = F.when(F.col("final") == "positive", 2.0).when(F.col("final") == "correction", -2.0).otherwise(0.0)
    score = end - 3 * F.col("corrections") / F.col("n") + F.when(F.col("commits") > 0, 1.0).otherwise(0.0)
    return rows.select("session_key", "corrections", "final", "commits", score.alias("score"))


def pattern_success(patterns: DataFrame, scores: DataFrame) -> DataFrame:
    """``pattern, present, absent, delta, low_quarter, high_quarter``: scores of sessions with and without each pattern.

    ``patterns`` is ``session_key, pattern``, distinct.  Quarters are the sessions
    at or beyond the quartiles of the score, and coverage is the share of them
    that have the pattern.  Those without a pattern are all less those with it.
    """
    cut = scores.agg(F.percentile("score", F.lit(0.25)).alias("q1"), F.percentile("score", F.lit(0.75)).alias("q3"))
    rows = scores.select("session_key", "score").crossJoin(F.broadcast(cut))
    rows = rows.select("session_key", "score", (F.col("score") <= F.col("q1")).cast("int").alias("low"), (F.col("score") >= F.col("q3")).cast("int").alias("high"))
    sums = lambda tag: [F.count("*").alias(f"n{tag}"), F.sum("score").alias(f"s{tag}"), F.sum("low").alias(f"l{tag}"), F.sum("high").alias(f"h{tag}")]
    own = patterns.join(rows, "session_key").groupBy("pattern").agg(*sums(""))
    both = own.crossJoin(F.broadcast(rows.agg(*sums("_all"))))
    present, absent = F.col("s") / F.col("n"), F.try_divide(F.col("s_all") - F.col("s"), F.col("n_all") - F.col("n"))
    return both.select(
        "pattern", present.alias("present"), absent.alias("absent"), (present - absent).alias("delta"),
        F.coalesce(F.try_divide("l", "l_all"), F.lit(0.0)).alias("low_quarter"), F.coalesce(F.try_divide("h", "h_all"), F.lit(0.0)).alias("high_quarter"),
    )


# --- survival ---


def maturity_groups(times: DataFrame, dated: DataFrame) -> DataFrame:
    """``times`` with ``grp``: whether a session began later in its project's life than the median one."""
    start = dated.groupBy("project").agg(F.min("ts").alias("start"))
    age = dated.join(start, "project").select("session_key", ((F.unix_micros("ts") - F.unix_micros("start")) / 86_400e6).alias("age"))
    middle = age.agg(F.percentile("age", F.lit(0.5)).alias("middle"))
    group = F.when(F.col("age") > F.col("middle"), "mature").otherwise("early")
    return times.join(age, "session_key").crossJoin(F.broadcast(middle)).select("session_key", "duration", "event", group.alias("grp"))


def hazard_shape(times: DataFrame, width: float = 3.0) -> DataFrame:
    """One row ``early, late, ratio, trend``: the smoothed hazard's means over the first and last third of its times.

    The increments of the cumulative hazard are smoothed with an Epanechnikov
    kernel; a ratio above 1.3 is increasing, below 0.7 decreasing.
    """
    up = W.orderBy("duration")  # one row a distinct duration
    steps = trends.nelson_aalen(times).select("duration", F.col("hazard"), (F.row_number().over(up) - 1).alias("i"))
    steps = steps.withColumn("step", F.col("hazard") - F.coalesce(F.lag("hazard").over(up), F.lit(0.0)))
    other = steps.select(F.col("duration").alias("at"), F.col("step").alias("jump"))
    u = (F.col("duration") - F.col("at")) / width
    near = steps.join(other, F.abs(F.col("duration") - F.col("at")) <= width)
    smooth = near.groupBy("i").agg(F.sum(0.75 * (1 - u * u) / width * F.col("jump")).alias("h"))
    size = F.count("*").over(W.partitionBy())
    thirds = smooth.withColumn("n", size).agg(
        F.avg(F.when(F.col("i") < F.floor(F.col("n") / 3), F.col("h"))).alias("early"), F.avg(F.when(F.col("i") >= F.floor(2 * F.col("n") / 3), F.col("h"))).alias("late")
    )
    ratio = F.when(F.col("early") > 0, F.col("late") / F.col("early")).otherwise(1.0)
    trend = F.when(ratio > 1.3, "increasing").when(ratio < 0.7, "decreasing").otherwise("flat")
    return thirds.select("early", "late", ratio.alias("ratio"), trend.alias("trend"))


# --- control charts ---


def three_sigma(points: DataFrame) -> DataFrame:
    """Points beyond three sample deviations from the mean."""
    row = points.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    z = (F.col("value") - F.col("mean")) / F.col("sd")
    return points.crossJoin(F.broadcast(row)).where(F.col("sd") > 0).select("i", "session_id", z.alias("z")).where("abs(z) > 3")


# --- ecology ---


def dominance(counts: DataFrame) -> DataFrame:
    """``group, dominant, dominance`` of ``group, symbol, n``: the most used symbol and its share."""
    first = F.min_by("symbol", F.struct(-F.col("n"), "symbol"))
    return counts.groupBy("group").agg(first.alias("dominant"), (F.max("n") / F.sum("n")).alias("dominance"))


def diet_breadth(uses: DataFrame) -> DataFrame:
    """``session_key, types, shannon, simpson, dominance`` of ``session_key, prey``."""
    counts = uses.where("prey is not null").groupBy("session_key", "prey").agg(F.count("*").alias("n"))
    by = counts.groupBy("session_key").agg(F.count("*").alias("types"), F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.max("n").alias("top"))
    shannon = F.when(F.col("types") > 1, F.log("all") - F.col("nlogn") / F.col("all")).otherwise(0.0)
    return by.select("session_key", "types", shannon.alias("shannon"), (1 - F.col("nn") / (F.col("all") * F.col("all"))).alias("simpson"), (F.col("top") / F.col("all")).alias("dominance"))


def switching_costs(turns: DataFrame) -> DataFrame:
    """``session_key, switches, mean_cost``: turns without a patch between two visits, of ``session_key, turn, patch``."""
    w = W.partitionBy("session_key").orderBy("turn")
    rows = turns.withColumn("all", F.row_number().over(w)).where("patch is not null")
    rows = rows.withColumns({"last": F.lag("all").over(w), "same": F.lag("patch").over(w).eqNullSafe(F.col("patch"))})
    gap = F.col("all") - F.col("last") - 1
    moved = rows.where(F.col("last").isNotNull() & (~F.col("same") | (gap > 0)))
    return moved.groupBy("session_key").agg(F.count("*").alias("switches"), F.avg(gap).alias("mean_cost"))


# --- entropy anomalies and events ---


def anomaly_overlap(windows: DataFrame, marks: DataFrame, width: int = 20, reach: int = 2, least: int = 5) -> DataFrame:
    """``session_key, anomalies, near, share``: two-sigma windows within ``reach`` windows of an event.

    ``windows`` is ``session_key, start, entropy``, ``marks`` is ``session_key, pos`` (from 1).  An
    event at a place belongs to the window in whose middle it is.
    """
    own = W.partitionBy("session_key")
    rows = windows.withColumns({"mean": F.avg("entropy").over(own), "sd": F.stddev_pop("entropy").over(own), "n": F.count("*").over(own)})
    odd = rows.where((F.col("n") >= least) & (F.col("sd") >= 1e-10) & (F.abs(F.col("entropy") - F.col("mean")) > 2 * F.col("sd"))).select("session_key", (F.col("start") - 1).alias("at"))
    middle = F.greatest(F.lit(0), F.col("pos") - 1 - width // 2)
    hits = marks.select("session_key", F.explode(F.sequence(middle - reach, middle + reach)).alias("at")).distinct().withColumn("hit", F.lit(1))
    return odd.join(hits, ["session_key", "at"], "left").groupBy("session_key").agg(F.count("*").alias("anomalies"), F.count("hit").alias("near"), (F.count("hit") / F.count("*")).alias("share"))


# --- exact test ---


def _log_factorial(n: Column) -> Column:
    """ln n! of whole numbers: the exact sum for small ones, Stirling's series beyond."""
    table = F.array(*(F.lit(x) for x in _small_log_factorials()))
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 30, F.get(table, n.cast("int"))).otherwise(series)


def _small_log_factorials() -> list[float]:
    import math

    return [math.lgamma(i + 1) for i in range(30)]


def fisher_enrichment(rows: DataFrame) -> DataFrame:
    """``rows`` of ``a, b, c, d`` with ``p``: the probability of ``a`` or more in a 2 x 2 table with these margins."""
    total, marked, drawn = F.col("a") + F.col("b") + F.col("c") + F.col("d"), F.col("a") + F.col("c"), F.col("a") + F.col("b")
    choose = lambda n, k: _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
    rows = rows.withColumns({"__t": total, "__m": marked, "__d": drawn})
    term = lambda i: F.exp(choose(F.col("__m"), i) + choose(F.col("__t") - F.col("__m"), F.col("__d") - i) - choose(F.col("__t"), F.col("__d")))
    each = F.transform(F.sequence(F.col("a"), F.least("__m", "__d")), term)
    return rows.withColumn("p", F.least(F.lit(1.0), F.aggregate(each, F.lit(0.0), lambda s, x: s + x))).drop("__t", "__m", "__d")


# --- references over time ---


def monthly_references(references: DataFrame) -> DataFrame:
    """``month, references, projects`` of ``src, dst, ts``."""
    return references.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("references"), F.count_distinct("dst").alias("projects"))


def first_seen(sessions: DataFrame, references: DataFrame) -> DataFrame:
    """``project, first_active, first_referenced``: the first session of each project and its first mention by another."""
    active = sessions.groupBy("project").agg(F.min("ts").alias("first_active"))
    named = references.groupBy(F.col("dst").alias("project")).agg(F.min("ts").alias("first_referenced"))
    return active.join(named, "project", "full")


# --- comparing corpora ---


def status_counts(observations: DataFrame) -> DataFrame:
    """``metric, defined, undefined, min, max, mean, range, ratio`` of ``corpus, metric, status, value``; the ratio is of positive values."""
    value = F.when(F.col("status") == "defined", F.col("value"))
    positive = F.when(value > 0, value)
    return observations.groupBy("metric").agg(
        F.count_if(F.col("status") == "defined").alias("defined"), F.count_if(F.col("status") != "defined").alias("undefined"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("range"), (F.max(positive) / F.min(positive)).alias("ratio"),
    )
