"""Techniques over time: survival, control charts, timeline, adoption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import Frames
from ..operators.ordered import numbered, scans
from ..result import TechniqueResult, findings_of, technique, union

# --- survival ---


def correction_times(frames: Frames) -> DataFrame:
    """``session_key, duration, event``: user turns to the first correction, or all of them where there is none."""
    w = W.partitionBy("session_key").orderBy("msg_idx")
    rows = frames.messages.where("role = 'User'").select("session_key", F.row_number().over(w).alias("i"), (F.col("classification") == "HumanCorrection").alias("hit"))
    by = rows.groupBy("session_key").agg(F.min(F.when(F.col("hit"), F.col("i"))).alias("first"), F.count("*").alias("n"))
    every = frames.sessions.select("session_key").join(by, "session_key", "left")
    return every.select("session_key", F.coalesce("first", "n", F.lit(0)).alias("duration"), F.col("first").isNotNull().alias("event"))


def risk_table(times: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Deaths, censored and at risk at each duration, within the groups ``by``."""
    by = by or []
    rows = times.groupBy(*by, "duration").agg(F.count_if("event").alias("d"), F.count("*").alias("n"))
    # Durations are turn counts, so the table has few rows, however many sessions there are.
    down = W.partitionBy(*by).orderBy(F.desc("duration"))
    return rows.select(*by, "duration", "d", (F.col("n") - F.col("d")).alias("censored"), F.sum("n").over(down).alias("at_risk"))


def kaplan_meier(times: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Survival S(t); 0 from the first time at which everybody at risk has the event."""
    up = W.partitionBy(*(by or [])).orderBy("duration")
    left = 1 - F.col("d") / F.col("at_risk")
    s = F.when(F.min(left).over(up) <= 0, 0.0).otherwise(F.exp(F.sum(F.log(F.when(left > 0, left))).over(up)))
    return risk_table(times, by).withColumn("survival", F.coalesce(s, F.lit(0.0)))


def nelson_aalen(times: DataFrame, by: list[str] | None = None) -> DataFrame:
    up = W.partitionBy(*(by or [])).orderBy("duration")
    return risk_table(times, by).withColumn("hazard", F.sum(F.col("d") / F.col("at_risk")).over(up))


def log_rank(times: DataFrame, group: str) -> DataFrame:
    """Observed and expected events of each group, and (O - E)^2 / E."""
    own = risk_table(times, [group]).select(group, "duration", "d", (F.col("d") + F.col("censored")).alias("leaving"))
    pooled = risk_table(times).where("d > 0").select("duration", F.col("d").alias("dd"), F.col("at_risk").alias("nn"))
    # Groups times distinct durations; a group is at risk at t with all who leave at t or later.
    sizes = own.groupBy(group).agg(F.sum("leaving").alias("size"), F.sum("d").alias("observed"))
    grid = sizes.select(group).join(pooled).join(own.select(group, "duration", "leaving"), [group, "duration"], "left")
    # Durations at which only censored ones leave are not in the pooled table.
    quiet = own.join(pooled.select("duration"), "duration", "left_anti").select(group, "duration", F.lit(0).alias("dd"), F.lit(1).alias("nn"), "leaving")
    grid = grid.select(group, "duration", "dd", "nn", F.coalesce("leaving", F.lit(0)).alias("leaving")).unionByName(quiet)
    gone = F.coalesce(F.sum("leaving").over(W.partitionBy(group).orderBy("duration").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    grid = grid.withColumn("gone", gone).join(sizes, group)
    by = grid.groupBy(group, "observed").agg(F.sum((F.col("size") - F.col("gone")) * F.col("dd") / F.col("nn")).alias("expected"))
    return by.select(group, "observed", "expected", F.coalesce(F.try_divide((F.col("observed") - F.col("expected")) ** 2, "expected"), F.lit(0.0)).alias("chi2"))


def cumulative_incidence(times: DataFrame) -> DataFrame:
    """Competing risks: ``duration, cause, incidence`` from ``duration, cause`` (null is censored).

    Each cause adds its share of those at risk times the survival of all just before.
    """
    every = kaplan_meier(times.select("duration", F.col("cause").isNotNull().alias("event")))
    up = W.orderBy("duration")
    before = every.select("duration", "at_risk", F.coalesce(F.lag("survival").over(up), F.lit(1.0)).alias("left"))
    causes = times.where("cause is not null").groupBy("duration", "cause").agg(F.count("*").alias("k"))
    rows = causes.join(before, "duration").withColumn("step", F.col("left") * F.col("k") / F.col("at_risk"))
    return rows.select("duration", "cause", F.sum("step").over(W.partitionBy("cause").orderBy("duration")).alias("incidence"))


@technique("survival-analysis", needs=("sessions", "messages", "tool_calls"))
def survival_analysis(frames: Frames) -> TechniqueResult:
    """Time to the first correction: survival, cumulative hazard and proportional hazards."""
    from .numeric import cox_regression, survival_covariates

    times = correction_times(frames)
    km, na = kaplan_meier(times), nelson_aalen(times)
    at = lambda t: F.coalesce(F.max_by("survival", F.when(F.col("duration") <= t, F.col("duration"))), F.lit(1.0))
    row = km.agg(F.coalesce(F.min(F.when(F.col("survival") <= 0.5, F.col("duration"))), F.lit(-1)).alias("median_survival_turns"), at(10).alias("survival_at_10"), at(20).alias("survival_at_20"))
    up = W.orderBy("duration")
    second = na.select((F.col("hazard") - 2 * F.lag("hazard", 1).over(up) + F.lag("hazard", 2).over(up)).alias("x")).agg(F.avg("x").alias("x"))
    trend = second.select(F.when(F.col("x") > 0.001, "increasing").when(F.col("x") < -0.001, "decreasing").otherwise("constant").alias("hazard_trend"))
    sizes = times.agg(F.count_if("event").alias("sessions_with_correction"), F.count_if(~F.col("event")).alias("sessions_censored"))
    cox, concordance = cox_regression(survival_covariates(frames, times))
    fit = times.sparkSession.createDataFrame([(concordance,)], "cox_concordance double")
    tables = {
        "Survival Probabilities": km.select(F.col("duration").alias("Turn"), F.col("survival").alias("Survival Probability")),
        "Nelson-Aalen Hazard": na.select(F.col("duration").alias("Turn"), F.col("hazard").alias("Cumulative Hazard")),
        "Cox PH Model Covariates": cox,
    }
    return TechniqueResult("survival_analysis", tables, union(*(findings_of("survival_analysis", x) for x in (row, trend, fit, sizes))))


# --- control charts ---


def control_series(frames: Frames, least: int = 20) -> DataFrame:
    """Correction rate, tool error rate and mean assistant text length of sessions with enough messages, in time order."""
    m = frames.messages.groupBy("session_key").agg(
        F.count("*").alias("n"), F.min("ts").alias("ts"), F.count_if(F.col("role") == "User").alias("users"),
        F.count_if((F.col("role") == "User") & (F.col("classification") == "HumanCorrection")).alias("corrections"),
        F.avg(F.when(F.col("role") == "Assistant", F.length("text"))).alias("assistant_len"),
    )
    r = frames.tool_results.groupBy("session_key").agg(F.avg(F.coalesce("is_error", F.lit(False)).cast("int")).alias("tool_error_rate"))
    rows = m.where(F.col("n") >= least).join(r, "session_key", "left").join(frames.sessions.select("session_key", "session_id", "session_ord"), "session_key")
    return rows.select(
        "session_key", "session_id", "ts", "session_ord", F.coalesce(F.try_divide("corrections", "users"), F.lit(0.0)).alias("correction_rate"),
        F.coalesce("tool_error_rate", F.lit(0.0)).alias("tool_error_rate"), F.coalesce("assistant_len", F.lit(0.0)).alias("assistant_len"),
    )


def in_order(rows: DataFrame, value: str) -> DataFrame:
    """``i, session_id, ts, value, mr``: the individuals chart's points.

    One chart is one series; its order is numbered by intervals of the time, and
    a point meets the one before it by its number.
    """
    keyed = rows.select("session_id", "ts", "session_ord", F.col(value).cast("double").alias("value"), F.unix_micros("ts").alias("__at"))
    placed = numbered(keyed, "__at", [F.col("__at").asc_nulls_last(), "session_ord"], "n")
    points = placed.select((F.col("n") - 1).alias("i"), "session_id", "ts", "value")
    before = points.select((F.col("i") + 1).alias("i"), F.col("value").alias("last"))
    return points.join(before, "i", "left").select("i", "session_id", "ts", "value", F.abs(F.col("value") - F.col("last")).alias("mr"))


def control_limits(points: DataFrame) -> DataFrame:
    """Centre, limits and sigma of an I-MR chart."""
    row = points.agg(F.avg("value").alias("mean"), F.coalesce(F.avg("mr"), F.lit(0.0)).alias("mr_bar"))
    return row.select("mean", (F.col("mean") + 2.66 * F.col("mr_bar")).alias("ucl"), F.greatest(F.lit(0.0), F.col("mean") - 2.66 * F.col("mr_bar")).alias("lcl"), "mr_bar", (F.col("mr_bar") / 1.128).alias("sigma"))


def out_of_control(points: DataFrame) -> DataFrame:
    rows = points.crossJoin(F.broadcast(control_limits(points)))
    side = F.when(F.col("value") > F.col("ucl"), "UCL").when(F.col("value") < F.col("lcl"), "LCL")
    return rows.select("i", "session_id", "value", side.alias("limit_violated")).where("limit_violated is not null")


def two_of_three(points: DataFrame) -> DataFrame:
    """Centres of windows of three points of which two lie beyond two sigma on one side.

    Only points beyond the limit are looked at: each counts for the three windows it is in.
    """
    size = points.agg(F.count("*").alias("n"))
    rows = points.crossJoin(F.broadcast(control_limits(points))).where("sigma > 0")
    side = F.when(F.col("value") - F.col("mean") > 2 * F.col("sigma"), 1).when(F.col("mean") - F.col("value") > 2 * F.col("sigma"), -1)
    far = rows.select("i", side.alias("side")).where("side is not null")
    seen = far.select(F.explode(F.sequence(F.col("i") - 1, F.col("i") + 1)).alias("i"), "side").groupBy("i", "side").agg(F.count("*").alias("beyond"))
    inside = seen.crossJoin(F.broadcast(size)).where("i >= 1 and i <= n - 2 and beyond >= 2")
    return inside.groupBy("i").agg(F.max("beyond").alias("beyond"))


def cusum(points: DataFrame, sample: bool = False, alarm: float = 4.0) -> DataFrame:
    """Two-sided CUSUM with slack k = sigma / 2 and alarm at ``alarm`` sigma, from moving ranges or of the sample.

    The recurrence S = max(0, S + x) equals T - min(0, running min of T) with the
    running sum T, so it is two scans, each in intervals.
    """
    limits = control_limits(points).select("mean", "sigma")
    if sample:
        limits = points.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sigma"))
    rows = points.select("i", "value").crossJoin(F.broadcast(limits)).withColumn("k", 0.5 * F.col("sigma"))
    rows = scans(rows, "i", sums={"up": F.col("value") - F.col("mean") - F.col("k"), "down": F.col("mean") - F.col("k") - F.col("value")})
    rows = scans(rows, "i", least={"least_up": F.col("up"), "least_down": F.col("down")})
    side = lambda c: F.col(c) - F.least(F.lit(0.0), F.col(f"least_{c}"))
    rows = rows.withColumns({"s_hi": side("up"), "s_lo": side("down")})
    return rows.select("i", "s_hi", "s_lo", F.coalesce((F.col("sigma") > 0) & (F.greatest("s_hi", "s_lo") > alarm * F.col("sigma")), F.lit(False)).alias("alarm"))


def capability(points: DataFrame, lower: float, upper: float) -> DataFrame:
    """Three-sigma X chart on the sample deviation, with Cp and Cpk against specification limits."""
    row = points.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    cp = F.try_divide(F.lit(upper - lower), 6 * F.col("sd"))
    cpk = F.try_divide(F.least(upper - F.col("mean"), F.col("mean") - lower), 3 * F.col("sd"))
    return row.select("mean", "sd", (F.col("mean") + 3 * F.col("sd")).alias("ucl"), F.greatest(F.lit(0.0), F.col("mean") - 3 * F.col("sd")).alias("lcl"), cp.alias("cp"), cpk.alias("cpk"))


@technique("spc-control-charts", needs=("sessions", "messages", "tool_results"))
def spc_control_charts(frames: Frames) -> TechniqueResult:
    """Individuals charts, zone rule and CUSUM over sessions in time order."""
    rows = control_series(frames).persist()  # a few numbers a session, read for each chart
    metrics = ("correction_rate", "tool_error_rate", "assistant_len")
    points = {m: in_order(rows, m).persist() for m in metrics}
    tag = lambda df, m: df.withColumn("metric", F.lit(m))
    limits = union(*(tag(control_limits(p), m) for m, p in points.items())).select("metric", "mean", "ucl", "lcl", "mr_bar")
    ooc = union(*(tag(out_of_control(p), m) for m, p in points.items()))
    rule = union(*(tag(two_of_three(p), m) for m, p in points.items())).select(F.lit("2 of 3 beyond 2 sigma").alias("rule"), "metric", F.col("i").alias("session_index"))
    sums = cusum(points["correction_rate"])
    found = (
        rows.agg(F.count("*").alias("sessions_analyzed")),
        limits.where("metric = 'correction_rate'").select(F.col("mean").alias("correction_rate_mean"), F.col("ucl").alias("correction_rate_ucl")),
        ooc.agg(*(F.count_if(F.col("metric") == m).alias(f"{m}_ooc_count") for m in metrics)),
        sums.agg(F.min(F.when(F.col("alarm"), F.col("i"))).alias("cusum_first_alarm_index")),
        rule.agg(F.count("*").alias("rule2_violations")),
    )
    tables = {
        "Control Limits": limits,
        "Out-of-Control Sessions": ooc.orderBy("metric", "i").limit(20).select("session_id", "metric", "value", "limit_violated"),
        "Rule Violations": rule,
        **{f"{m} Series": p.select(F.col("i").alias("session_index"), "session_id", F.col("ts").alias("timestamp"), "value") for m, p in points.items()},
        "CUSUM Series": sums.select(F.col("i").alias("session_index"), F.greatest("s_hi", "s_lo").alias("cusum_value")),
    }
    return TechniqueResult("spc_control_charts", tables, union(*(findings_of("spc_control_charts", x) for x in found)))


# --- timeline ---


def dated_sessions(frames: Frames) -> DataFrame:
    """``session_key, project, date``: the day of the first message that has a time."""
    first = frames.messages.where("ts is not null").groupBy("session_key").agg(F.min_by("ts", "msg_idx").alias("ts"))
    return frames.sessions.select("session_key", F.coalesce("project", F.lit("(unknown)")).alias("project")).join(first, "session_key", "left").withColumn("date", F.date_format("ts", "yyyy-MM-dd"))


def ranked_sessions(dated: DataFrame) -> DataFrame:
    """``session_key, rank``: sessions by time, numbered in intervals."""
    keyed = dated.select("session_key", F.unix_micros("ts").alias("__at"))
    return numbered(keyed, "__at", ["__at", "session_key"], "rank").select("session_key", F.col("rank").cast("int").alias("rank"))


def timeline_cube(dated: DataFrame) -> DataFrame:
    """Day by project, day and project totals from one pass, told apart by ``level`` (GROUPING_ID)."""
    counted = dated.where("date is not null").groupBy("date", "project").agg(F.count("*").alias("n"))
    return counted.groupingSets([["date", "project"], ["date"], ["project"]], "date", "project").agg(
        F.grouping_id().alias("level"), F.sum("n").alias("session_count"), F.count("*").alias("cells"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen")
    )


@technique("corpus-timeline", needs=("sessions", "messages"))
def corpus_timeline(frames: Frames) -> TechniqueResult:
    """Sessions by day and project."""
    dated = dated_sessions(frames)
    cube = timeline_cube(dated)
    daily = cube.where("level = 0").select("date", "project", "session_count")
    totals = cube.where("level = 1").select("date", "session_count", F.col("cells").alias("distinct_projects"))
    projects = dated.where("date is not null").groupBy("project").agg(F.count("*").alias("session_count"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))
    found = (
        dated.agg(F.count("*").alias("total_sessions"), F.count_if(F.col("date").isNull()).alias("undated_sessions"), F.count_distinct("date").alias("total_dates"), F.count_distinct(F.when(F.col("date").isNotNull(), F.col("project"))).alias("total_projects"), F.min("date").alias("date_range_min"), F.max("date").alias("date_range_max")),
        totals.agg(F.count_if(F.col("distinct_projects") >= 3).alias("high_concurrency_day_count"), F.min_by("date", F.struct(-F.col("session_count"), "date")).alias("peak_day")),
    )
    tables = {"Daily Activity": daily, "Daily Totals": totals, "Project Totals": projects}
    return TechniqueResult("corpus-timeline", tables, union(*(findings_of("corpus-timeline", x) for x in found)))


# --- adoption of conventions ---


def session_pairs(calls: DataFrame) -> DataFrame:
    """``session_key, bigram``: the distinct pairs of consecutive tools of each session."""
    from ..operators.ordered import bigrams

    return bigrams(calls, ["session_key"], ["pos"], "name").select("session_key", F.concat_ws("->", "from", "to").alias("bigram")).distinct()


def convention_candidates(pairs: DataFrame, sessions: int, share: float = 0.1, least: int = 5) -> DataFrame:
    """Pairs in at least max(5, a tenth) of the sessions."""
    import math

    return pairs.groupBy("bigram").agg(F.count("*").alias("n_sessions")).where(F.col("n_sessions") >= max(least, math.ceil(share * sessions)))


def adoption_curves(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """``bigram, rank, adopters``: the cumulative number of sessions with the pair, by session rank."""
    rows = pairs.join(ranked, "session_key")
    return rows.select("bigram", "rank", F.row_number().over(W.partitionBy("bigram").orderBy("rank")).alias("adopters"))


def propagation(pairs: DataFrame, dated: DataFrame, projects: int) -> DataFrame:
    """First use of each pair in each project, origin, reach and latencies in days."""
    first = pairs.join(dated, "session_key").groupBy("bigram", "project").agg(F.min("ts").alias("first_seen"))
    origin = W.partitionBy("bigram").orderBy("first_seen", "project")
    rows = first.withColumns({"origin": F.first("project").over(origin), "start": F.first("first_seen").over(origin)})
    rows = rows.withColumn("latency_days", (F.unix_micros("first_seen") - F.unix_micros("start")) / 86_400e6)
    later = F.when(F.col("project") != F.col("origin"), F.col("latency_days"))
    return rows.groupBy("bigram", "origin").agg(F.count("*").alias("n_projects"), F.percentile(later, F.lit(0.5)).alias("median_latency_days")).withColumn("reach", F.col("n_projects") / projects)
