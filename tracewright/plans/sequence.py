"""Techniques on tool sequences: transitions, entropy, burstiness, diversity."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import Frames
from ..operators.ordered import bigrams, prefix_sum, two_before
from ..result import TechniqueResult, findings_from_rows, findings_of, technique, union

WINDOW = 20


def transitions(calls: DataFrame) -> DataFrame:
    """``from_tool, to_tool, n, probability`` over adjacent calls of a session."""
    counts = bigrams(calls, ["session_key"], ["pos"], "name").groupBy("from", "to").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("from"))
    return counts.select(F.col("from").alias("from_tool"), F.col("to").alias("to_tool"), "n", (F.col("n") / total).alias("probability"))


def entry_tools(calls: DataFrame) -> DataFrame:
    return calls.where("pos = 1").groupBy("name").agg(F.count("*").alias("n"))


def stationary(table: DataFrame, rounds: int = 1000, tolerance: float = 1e-8) -> dict[str, float]:
    """Power iteration from the uniform vector; tools without successors lose their mass.

    Only the tool-by-tool table reaches the driver.
    """
    rows = table.select("from_tool", "to_tool", "probability").collect()
    tools = sorted({r.from_tool for r in rows} | {r.to_tool for r in rows})
    at = {t: i for i, t in enumerate(tools)}
    p = np.zeros((len(tools), len(tools)))
    for r in rows:
        p[at[r.from_tool], at[r.to_tool]] = r.probability
    x = np.full(len(tools), 1 / max(1, len(tools)))
    for _ in range(rounds):
        x, before = x @ p, x
        if np.abs(x - before).sum() < tolerance:
            break
    return dict(zip(tools, x.tolist(), strict=True))


@technique("markov", essential=True)
def markov(frames: Frames) -> TechniqueResult:
    """Transition probabilities between consecutive tools."""
    calls = frames.tool_calls
    table = transitions(calls)
    top = table.orderBy(F.desc("probability"), "from_tool", "to_tool").limit(5)
    nth = F.row_number().over(W.orderBy(F.desc("probability"), "from_tool", "to_tool")).cast("string")
    top = top.select(F.concat(F.lit("top_transition_"), nth).alias("label"), F.struct(F.col("from_tool").alias("from"), F.col("to_tool").alias("to"), "probability").alias("value"))
    loops = table.where("from_tool = to_tool")
    entries = entry_tools(calls).orderBy(F.desc("n"), "name").limit(5)
    findings = union(
        findings_of("markov", table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_bigrams"))),
        findings_from_rows("markov", top, F.col("label"), F.col("value")),
        findings_from_rows("markov", loops, F.concat(F.lit("self_loop_"), "from_tool"), F.col("probability")),
        findings_from_rows("markov", entries, F.concat(F.lit("entry_tool_"), "name"), F.col("n")),
    )
    fixed = stationary(table)
    spark = calls.sparkSession
    point = spark.createDataFrame(sorted(fixed.items()), "tool string, share double")
    findings = union(findings, findings_from_rows("markov", point, F.concat(F.lit("stationary_"), "tool"), F.col("share")))
    return TechniqueResult("markov", {"transition_matrix": table, "stationary": point}, findings)


def transition_matrix(table: DataFrame, tools: list[str]) -> DataFrame:
    """The wide form: one column a tool, absent transitions 0."""
    return table.groupBy("from_tool").pivot("to_tool", tools).agg(F.first("probability")).na.fill(0.0)


def _spread(symbols, width: int):
    """Sum of c log2 c over the counts of equal elements, by one pass over the sorted array."""
    f = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))

    def step(acc, x):
        run = F.when(acc["last"].eqNullSafe(x), acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), (acc["sum"] + F.get(f, run) - F.get(f, run - 1)).alias("sum"))

    return F.aggregate(F.array_sort(symbols), start, step, lambda acc: acc["sum"])


def entropy_windows(calls: DataFrame, width: int = WINDOW) -> DataFrame:
    """``session_key, start, entropy``: conditional entropy of each full window.

    A window's 19 pairs give H = (sum f(c(x)) - sum f(c(x, y))) / 19 with
    f(c) = c log2 c, so windows stay rows of one shuffle by session instead of 19.
    """
    ahead = W.partitionBy("session_key").orderBy("pos").rowsBetween(0, width - 1)
    rows = calls.select("session_key", F.col("pos").alias("start"), F.collect_list("name").over(ahead).alias("w"))
    rows = rows.where(F.size("w") == width)
    first = F.slice("w", 1, width - 1)
    pairs = F.zip_with(first, F.slice("w", 2, width - 1), lambda x, y: F.concat(x, F.lit("\u0001"), y))
    entropy = F.greatest(F.lit(0.0), (_spread(first, width) - _spread(pairs, width)) / (width - 1))
    return rows.select("session_key", "start", entropy.alias("entropy"))


def entropy_sessions(windows: DataFrame) -> DataFrame:
    """Mean, population deviation and two-sigma anomalies of each session."""
    own = W.partitionBy("session_key")
    rows = windows.withColumns({"mean": F.avg("entropy").over(own), "sd": F.stddev_pop("entropy").over(own)})
    odd = F.col("sd") > 0
    return rows.groupBy("session_key").agg(
        F.first("mean").alias("mean_entropy"),
        F.first("sd").alias("stddev"),
        F.count_if(odd & (F.col("entropy") < F.col("mean") - 2 * F.col("sd"))).alias("low"),
        F.count_if(odd & (F.col("entropy") > F.col("mean") + 2 * F.col("sd"))).alias("high"),
        F.count("*").alias("windows"),
    )


@technique("entropy", essential=True)
def entropy(frames: Frames) -> TechniqueResult:
    """Conditional entropy of sliding windows of 20 tools, with anomalies."""
    sessions = entropy_sessions(entropy_windows(frames.tool_calls))
    row = sessions.agg(
        F.avg("mean_entropy").alias("mean_entropy"),
        F.coalesce(F.sum(F.col("low") + F.col("high")), F.lit(0)).alias("anomaly_count"),
        F.coalesce(F.sum("low"), F.lit(0)).alias("low_entropy_anomalies"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("high_entropy_anomalies"),
        F.count("*").alias("sessions_analyzed"),
    )
    ratio = F.when(F.col("high_entropy_anomalies") > 0, (F.col("low_entropy_anomalies") / F.col("high_entropy_anomalies")).cast("string"))
    row = row.withColumn("low_high_ratio", ratio.when(F.col("low_entropy_anomalies") > 0, "Infinity").otherwise("0.0"))
    table = sessions.select(F.col("session_key").alias("session_id"), "mean_entropy", "stddev", (F.col("low") + F.col("high")).alias("num_anomalies"))
    return TechniqueResult("entropy", {"per_session_entropy": table}, findings_of("entropy", row))


def global_places(frames: Frames) -> DataFrame:
    """Tool calls with ``place`` in the concatenation of all sessions (by ``session_ord``, which is unique)."""
    lengths = frames.tool_calls.groupBy("session_key").agg(F.count("*").alias("n")).join(frames.sessions.select("session_key", "session_ord"), "session_key")
    offsets = prefix_sum(lengths, "session_ord", "n", "offset").select("session_key", "offset")
    return frames.tool_calls.join(offsets, "session_key").select("name", (F.col("offset") + F.col("pos")).alias("place"))


def tool_burstiness(frames: Frames) -> DataFrame:
    """Burstiness B and memory M of each tool called at least twice.

    Intervals run over the concatenated sequence, so they cross session borders.
    """
    rows = two_before(global_places(frames), "name", "place", frames.tool_calls.count())
    gap, before = F.col("place") - F.col("prev1") - 1, F.col("prev1") - F.col("prev2") - 1
    stats = rows.select("name", gap.alias("gap"), before.alias("before")).groupBy("name").agg(
        F.count("*").alias("n"), F.count("gap").alias("gaps"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"),
        F.try_divide(F.covar_pop("before", "gap"), F.stddev_pop("before") * F.stddev_pop(F.when(F.col("before").isNotNull(), F.col("gap")))).alias("r"),
    )
    total = F.col("sd") + F.col("mean")
    b = F.when(F.col("n") == 2, F.when(F.col("mean") > 0, -1.0).otherwise(1.0)).when(total == 0, 1.0).otherwise((F.col("sd") - F.col("mean")) / total)
    m = F.when(F.col("gaps") >= 3, F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)))
    return stats.where("n >= 2").select(F.col("name").alias("tool_name"), b.alias("burstiness_b"), m.alias("memory_m"), F.col("mean").alias("mean_interval"), F.col("n").alias("count"))


def burstiness_aggregate(table: DataFrame) -> DataFrame:
    """Means weighted by calls; memory only over tools that have one."""
    with_m = F.when(F.col("memory_m").isNotNull(), F.col("count"))
    return table.agg(
        (F.sum(F.col("burstiness_b") * F.col("count")) / F.sum("count")).alias("aggregate_burstiness"),
        (F.sum(F.col("memory_m") * F.col("count")) / F.sum(with_m)).alias("aggregate_memory"),
        F.count("*").alias("tools_analyzed"),
    )


@technique("burstiness", essential=True)
def burstiness(frames: Frames) -> TechniqueResult:
    """Burstiness and memory of the gaps between uses of a tool."""
    table = tool_burstiness(frames)
    rounded = table.select("tool_name", *(F.round(c, 4).alias(c) for c in ("burstiness_b", "memory_m", "mean_interval")), "count")
    named = F.struct(F.col("tool_name").alias("name"), F.round("burstiness_b", 4).alias("B"))
    ends = table.agg(F.min_by(named, F.struct(-F.col("burstiness_b"), "tool_name")).alias("burstiest_tool"), F.min_by(named, F.struct("burstiness_b", "tool_name")).alias("most_periodic_tool"))
    sums = burstiness_aggregate(table).select(F.round("aggregate_burstiness", 4).alias("aggregate_burstiness"), F.round("aggregate_memory", 4).alias("aggregate_memory"), "tools_analyzed")
    return TechniqueResult("burstiness", {"per_tool_burstiness": rounded}, union(findings_of("burstiness", sums), findings_of("burstiness", ends)))


def session_diversity(frames: Frames) -> DataFrame:
    """Shannon, Simpson, evenness, richness and abundance of each session, also of those without tools."""
    counts = frames.tool_calls.groupBy("session_key", "name").agg(F.count("*").alias("n"))
    by = counts.groupBy("session_key").agg(
        F.sum("n").alias("abundance"), F.count("*").alias("richness"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.sum(F.col("n") * F.col("n")).alias("nn")
    )
    all_ = frames.sessions.select("session_key").join(by, "session_key", "left").na.fill(0, ["abundance", "richness", "nlogn", "nn"])
    some = F.col("abundance") > 0
    shannon = F.when(some, F.log("abundance") - F.col("nlogn") / F.col("abundance")).otherwise(0.0)
    shannon = F.when(F.col("richness") <= 1, 0.0).otherwise(shannon)
    return all_.select(
        "session_key",
        shannon.alias("shannon"),
        F.when(some, 1 - F.col("nn") / (F.col("abundance") * F.col("abundance"))).otherwise(0.0).alias("simpson"),
        F.when(F.col("richness") > 1, shannon / F.log("richness")).otherwise(0.0).alias("evenness"),
        "richness",
        "abundance",
    )


def species_area(table: DataFrame) -> DataFrame:
    """Slope z and R2 of ln richness on ln abundance; 0 where there is nothing to fit."""
    x, y = F.log("abundance"), F.log("richness")
    some = table.where("abundance > 0")
    flat = F.coalesce(F.var_pop(x), F.lit(0.0)) < 1e-15
    still = F.coalesce(F.var_pop(y), F.lit(0.0)) < 1e-15
    return some.agg(
        F.when((F.count("*") < 2) | flat, 0.0).otherwise(F.regr_slope(y, x)).alias("z"),
        F.when((F.count("*") < 2) | flat | still, 0.0).otherwise(F.regr_r2(y, x)).alias("r_squared"),
    )


def diversity_summary(table: DataFrame) -> DataFrame:
    mono = F.count_if(F.col("evenness") < 0.3)
    return table.agg(
        F.avg("shannon").alias("mean_shannon"),
        F.percentile("shannon", F.lit(0.5)).alias("median_shannon"),
        F.avg("simpson").alias("mean_simpson"),
        F.avg("evenness").alias("mean_evenness"),
        mono.alias("monoculture_count"),
        F.coalesce(F.try_divide(mono, F.count("*")), F.lit(0.0)).alias("monoculture_fraction"),
        F.count("*").alias("sessions_analyzed"),
    )


@technique("diversity", essential=True, needs=("sessions", "tool_calls"))
def diversity(frames: Frames) -> TechniqueResult:
    """Ecological diversity of the tools in a session."""
    table = session_diversity(frames)
    area = species_area(table).select(F.col("z").alias("species_area_z"), F.col("r_squared").alias("species_area_r_squared"))
    findings = union(findings_of("diversity", diversity_summary(table)), findings_of("diversity", area))
    return TechniqueResult("diversity", {"per_session_diversity": table.withColumnRenamed("session_key", "session_id")}, findings)
