"""Iterative estimators: hidden states, Granger tests, proportional hazards, alignments, compression distances, time patterns, curves and change points.

Features come from SQL.  What is estimated for one session, pair or convention
runs in ``applyInPandas``; models of the whole corpus are fitted on all of it, by
sums over partitions.
"""

from __future__ import annotations

import itertools
import math
import pickle
import zlib
from collections import Counter
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import Frames
from ..functions import patterns as P
from ..functions import stats
from ..operators.ordered import runs
from ..result import TechniqueResult, findings_from_rows, findings_of, technique, union
from . import process, trends
from .extras import project_id

SAMPLE = 50


def sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` keys with the least hashes: a sample that does not depend on row order."""
    keys = df.select(key).distinct().orderBy(F.xxhash64(F.lit(42), key), key).limit(n)
    return df.join(F.broadcast(keys), key, "left_semi")  # at most ``n`` keys


def one_row(spark, technique_name: str, values: dict) -> DataFrame:
    """Findings of driver-side numbers."""
    import json

    clean = lambda v: None if isinstance(v, float) and not math.isfinite(v) else v
    rows = [(technique_name, k, json.dumps(clean(v)), None) for k, v in values.items()]
    from ..result import FINDINGS

    return spark.createDataFrame(rows, FINDINGS)


# --- hidden Markov model ---

FEATURES = ("read", "edit", "bash", "search", "skill", "other", "log_text", "thinking_len", "n_tools")


def turn_features(frames: Frames) -> DataFrame:
    """``session_key, turn, <features>, corrected``: assistant turns, and whether a correction follows at once."""
    category = P.tool_category(F.col("name"))
    tools = frames.tool_calls.groupBy("session_key", "msg_idx").agg(*(F.max((category == c).cast("double")).alias(c) for c in FEATURES[:6]), F.count("*").cast("double").alias("n_tools"))
    w = W.partitionBy("session_key").orderBy("msg_idx")
    rows = frames.messages.withColumn("corrected", F.coalesce((F.lead("role").over(w) == "User") & (F.lead("classification").over(w) == "HumanCorrection"), F.lit(False)))
    rows = rows.where("role = 'Assistant'").join(tools, ["session_key", "msg_idx"], "left")
    return rows.select(
        "session_key", F.row_number().over(w).alias("turn"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in FEATURES[:6]),
        F.log1p(F.length(F.coalesce("text", F.lit("")))).alias("log_text"), F.coalesce(F.length("thinking"), F.lit(0)).cast("double").alias("thinking_len"),
        F.coalesce("n_tools", F.lit(0.0)).alias("n_tools"), "corrected",
    )


@dataclass
class Hmm:
    """Gaussian hidden Markov model with diagonal covariance."""

    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    loglik: float = -math.inf

    def emission(self, x: np.ndarray) -> np.ndarray:
        d = (x[..., None, :] - self.mean) ** 2 / self.var
        return -0.5 * (d + np.log(2 * math.pi * self.var)).sum(axis=-1)

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        e, log = self.emission(x), np.log(self.move + 1e-300)
        score, back = np.log(self.start + 1e-300) + e[0], []
        for t in range(1, len(x)):
            total = score[:, None] + log
            back.append(total.argmax(axis=0))
            score = total.max(axis=0) + e[t]
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return np.array(path[::-1])


def fit_hmm(sequences: list[np.ndarray], n: int, rounds: int = 100, tolerance: float = 1e-2, seed: int = 42) -> Hmm:
    """Expectation-maximisation over all sequences at once (padded), from seeded k-means centres."""
    flat = np.concatenate(sequences)
    rng = np.random.default_rng(seed)
    centre = flat[rng.choice(len(flat), n, replace=False)]
    for _ in range(20):
        own = ((flat[:, None] - centre) ** 2).sum(axis=2).argmin(axis=1)
        centre = np.array([flat[own == k].mean(axis=0) if (own == k).any() else centre[k] for k in range(n)])
    floor = 1e-3 + 1e-3 * flat.var(axis=0)
    model = Hmm(np.full(n, 1 / n), np.full((n, n), 1 / n), centre, np.tile(flat.var(axis=0) + floor, (n, 1)))
    for _ in range(rounds):
        sums = expected(model, sequences)
        gain = sums[0] - model.loglik
        model = maximised(sums, floor)
        if abs(gain) < tolerance:
            break
    return model


def expected(model: Hmm, sequences: list[np.ndarray]) -> tuple:
    """Expectation step over some sequences (padded): log likelihood, and sums of starts, moves, weights, values and squares."""
    n = len(model.start)
    size = np.array([len(s) for s in sequences])
    most, count = size.max(), len(sequences)
    x = np.zeros((count, most, sequences[0].shape[1]))
    for i, s in enumerate(sequences):
        x[i, : len(s)] = s
    live = np.arange(most)[None] < size[:, None]
    e = model.emission(x)
    top = e.max(axis=2, keepdims=True)
    like = np.where(live[..., None], np.exp(e - top), 1.0)
    alpha, scale = np.empty_like(like), np.ones((count, most))
    for t in range(most):
        a = (model.start if t == 0 else alpha[:, t - 1] @ model.move) * like[:, t]
        s = a.sum(axis=1) + 1e-300
        a = a / s[:, None]
        keep = live[:, t]
        alpha[:, t] = a if t == 0 else np.where(keep[:, None], a, alpha[:, t - 1])
        scale[:, t] = np.where(keep, s, 1.0)
    total = float((np.log(scale) + np.where(live, top[..., 0], 0.0)).sum())
    beta, pair = np.ones_like(like), np.zeros((n, n))
    for t in range(most - 2, -1, -1):
        nxt = like[:, t + 1] * beta[:, t + 1] / scale[:, t + 1][:, None]
        keep = live[:, t + 1]
        beta[:, t] = np.where(keep[:, None], nxt @ model.move.T, 1.0)
        pair += np.einsum("si,ij,sj->ij", alpha[keep, t], model.move, nxt[keep])
    gamma = alpha * beta
    gamma = np.where(live[..., None], gamma / (gamma.sum(axis=2, keepdims=True) + 1e-300), 0.0)
    return total, gamma[:, 0].sum(axis=0), pair, gamma.sum(axis=(0, 1)), np.einsum("stk,std->kd", gamma, x), np.einsum("stk,std->kd", gamma, x**2)


def maximised(sums: tuple, floor: np.ndarray) -> Hmm:
    """Maximisation step."""
    total, start, pair, weight, values, squares = sums
    weight = weight + 1e-12
    mean = values / weight[:, None]
    var = squares / weight[:, None] - mean**2
    return Hmm(start / start.sum(), (pair + 1e-12) / (pair + 1e-12).sum(axis=1, keepdims=True), mean, np.maximum(var, 0) + floor, total)


def session_sums(paths: DataFrame, work) -> tuple:
    """Element sums of ``work(sequences)`` over all sessions; one row a partition reaches the driver."""

    def partial(batches):
        out = None
        for pdf in batches:
            seqs = sorted((np.asarray(x, float).reshape(-1, len(FEATURES)) for x in pdf.path), key=len)
            while seqs:  # padded blocks of a bounded size, or one session
                take = 1
                while take < len(seqs) and (take + 1) * len(seqs[-take - 1]) <= 50_000 and (take + 1) * len(seqs[-1]) <= 100_000:
                    take += 1
                own = work(seqs[-take:])
                out = own if out is None else [[a + b for a, b in zip(p, q, strict=True)] for p, q in zip(out, own, strict=True)]
                del seqs[-take:]
        if out is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "found": [pickle.dumps(out)]})

    rows = sorted(paths.mapInPandas(partial, "part int, found binary").collect(), key=lambda r: r.part)
    found = [pickle.loads(bytes(r.found)) for r in rows]
    return [[sum(x[1:], x[0]) for x in zip(*each, strict=True)] for each in zip(*found, strict=True)]


def fitted_hmm(features: DataFrame, sizes=range(2, 6), rounds: int = 100, tolerance: float = 1e-2) -> Hmm | None:
    """:func:`best_hmm` of all sessions of ``session_key, turn, <features>``, its sums taken by partition.

    All sizes advance in the same job; the first centres are the distinct turns of least hash.
    """
    turn = F.struct("turn", F.array(*(F.col(c).cast("double") for c in FEATURES)).alias("x"))
    paths = features.groupBy("session_key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(turn)), lambda r: r["x"])).alias("path"))
    paths = paths.sortWithinPartitions("session_key").select("path").persist()
    first = features.groupBy(*FEATURES).count().orderBy(F.xxhash64(F.lit(42), *FEATURES), *FEATURES).limit(max(sizes)).toPandas()  # one row a state
    if not len(first):
        return None
    (turns, total, square), = session_sums(paths, lambda seqs: [[float(sum(map(len, seqs))), sum(s.sum(axis=0) for s in seqs), sum((s**2).sum(axis=0) for s in seqs)]])
    spread = np.maximum(square / turns - (total / turns) ** 2, 0)
    floor = 1e-3 + 1e-3 * spread
    sizes = [n for n in sizes if n <= turns]
    centres = [np.resize(first[list(FEATURES)].to_numpy(float), (n, len(FEATURES))) for n in sizes]

    def nearest(seqs):
        flat, out = np.concatenate(seqs), []
        for c in centres:
            own = np.eye(len(c))[((flat[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)]
            out.append([own.sum(axis=0), own.T @ flat])
        return out

    for _ in range(20):
        after = [np.where(n[:, None] > 0, v / np.maximum(n, 1)[:, None], c) for (n, v), c in zip(session_sums(paths, nearest), centres, strict=True)]
        still = all((a == c).all() for a, c in zip(after, centres, strict=True))
        centres = after
        if still:
            break
    models = {n: Hmm(np.full(n, 1 / n), np.full((n, n), 1 / n), c, np.tile(spread + floor, (n, 1))) for n, c in zip(sizes, centres, strict=True)}
    open_ = list(models)
    for _ in range(rounds):
        now = [models[n] for n in open_]
        found = session_sums(paths, lambda seqs: [list(expected(m, seqs)) for m in now])
        gains = [sums[0] - models[n].loglik for n, sums in zip(open_, found, strict=True)]
        for n, sums in zip(open_, found, strict=True):
            models[n] = maximised(sums, floor)
        open_ = [n for n, g in zip(open_, gains, strict=True) if abs(g) >= tolerance]
        if not open_:
            break
    paths.unpersist()
    width = len(FEATURES)
    return min(models.items(), key=lambda x: ((x[0] * (x[0] - 1) + 2 * x[0] * width) * math.log(turns) - 2 * x[1].loglik, x[0]), default=(0, None))[1]


def best_hmm(sequences: list[np.ndarray], sizes=range(2, 6)) -> Hmm | None:
    """The model of least BIC with p = n (n - 1) + 2 n d parameters."""
    turns, width = sum(map(len, sequences)), sequences[0].shape[1]
    found = [(n * (n - 1) + 2 * n * width) * math.log(turns) - 2 * m.loglik for n in sizes if n <= turns for m in [fit_hmm(sequences, n)]]
    return fit_hmm(sequences, list(sizes)[int(np.argmin(found))]) if found else None


def hidden_states(features: DataFrame, model: Hmm) -> DataFrame:
    """``session_key, turn, state, corrected``: most likely states of every session."""

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        return pdf[["session_key", "turn"]].assign(state=model.viterbi(pdf[list(FEATURES)].to_numpy(float)), corrected=pdf.corrected)

    return features.groupBy("session_key").applyInPandas(decode, "session_key string, turn int, state int, corrected boolean")


def state_summary(states: DataFrame) -> DataFrame:
    """Turns, share, share before corrections, lift and mean run length of each state."""
    run = runs(states, ["session_key"], ["turn"], ["state"])
    length = run.groupBy("session_key", "run", "state").agg(F.count("*").alias("n")).groupBy("state").agg(F.avg("n").alias("mean_duration"))
    by = states.groupBy("state").agg(F.count("*").alias("turns"), F.count_if("corrected").alias("before_correction"))
    all_ = W.partitionBy()
    share = F.col("turns") / F.sum("turns").over(all_)
    pre = F.try_divide("before_correction", F.sum("before_correction").over(all_))
    return by.select("*", share.alias("share"), F.coalesce(pre / share, F.lit(0.0)).alias("lift")).join(length, "state")


@technique("hsmm", needs=("messages", "tool_calls"))
def hsmm(frames: Frames, least_sessions: int = 10, least_turns: int = 20) -> TechniqueResult:
    """Hidden behavioural states and the one before corrections."""
    spark = frames.sessions.sparkSession
    features = turn_features(frames)
    size = features.agg(F.count_distinct("session_key").alias("sessions"), F.count("*").alias("turns")).first()
    if size.sessions < least_sessions or size.turns < least_turns:
        return TechniqueResult("hsmm", {}, spark.createDataFrame([], "technique string, label string, value_json string, description string"))
    model = fitted_hmm(features)
    summary = state_summary(hidden_states(features, model)).orderBy(F.desc("before_correction"), "state").toPandas()  # at most five rows
    at = FEATURES.index
    exploring = model.mean[:, at("read")] + model.mean[:, at("search")] > model.mean[:, [at(c) for c in ("edit", "bash", "skill", "other")]].sum(axis=1)
    kind = summary.state.map(lambda s: "exploring" if exploring[s] else "executing")
    mean_of = lambda k: float((summary.mean_duration * summary.turns)[kind == k].sum() / max(1, summary.turns[kind == k].sum()))
    findings = one_row(spark, "hsmm", {
        "optimal_n_states": len(model.start), "pre_correction_lift": round(float(summary.lift.iloc[0]), 4), "dominant_pre_correction_state": int(summary.state.iloc[0]),
        "mean_state_duration_exploring": round(mean_of("exploring"), 4), "mean_state_duration_executing": round(mean_of("executing"), 4),
    })
    names = [f"State {i}" for i in range(len(model.start))]
    move = spark.createDataFrame(pd.DataFrame(model.move, columns=names).assign(**{"From State": names})[["From State", *names]])
    traits = spark.createDataFrame(pd.DataFrame(model.mean.T, columns=names).assign(Feature=FEATURES)[["Feature", *names]])
    return TechniqueResult("hsmm", {"State Transition Matrix": move, "State Characteristics": traits}, findings)


# --- Granger causality ---

SERIES = ("thinking_ratio", "tool_diversity", "text_length", "correction", "tool_failure")


def granger_features(frames: Frames, least: int = 25) -> DataFrame:
    """Five series over assistant turns of sessions with at least ``least``.

    Tool diversity is the entropy of categories over five turns.  A call's result
    is found by its id; of several results the last one counts.
    """
    w = W.partitionBy("session_key").orderBy("msg_idx")
    last = frames.tool_results.groupBy("session_key", "tool_use_id").agg(F.max_by("is_error", F.struct("msg_idx", "res_idx")).alias("is_error"))
    calls = frames.tool_calls.withColumn("category", P.tool_category(F.col("name"))).join(last.withColumnRenamed("tool_use_id", "call_id"), ["session_key", "call_id"], "left")
    tools = calls.groupBy("session_key", "msg_idx").agg(F.max(F.coalesce("is_error", F.lit(False)).cast("double")).alias("failure"), *(F.count_if(F.col("category") == c).alias(c) for c in FEATURES[:6]))
    rows = frames.messages.withColumn("corrected", F.coalesce((F.lead("role").over(w) == "User") & (F.lead("classification").over(w) == "HumanCorrection"), F.lit(False)).cast("double"))
    rows = rows.where("role = 'Assistant'").join(tools, ["session_key", "msg_idx"], "left").na.fill(0)
    recent = w.rowsBetween(-4, 0)
    sums = [F.sum(c).over(recent) for c in FEATURES[:6]]
    total = sum(sums[1:], sums[0])
    entropy = sum((F.when(s > 0, -(s / total) * F.log2(s / total)).otherwise(0.0) for s in sums), F.lit(0.0))
    text, thinking = F.length(F.coalesce("text", F.lit(""))), F.length(F.coalesce("thinking", F.lit("")))
    rows = rows.select(
        "session_key", F.row_number().over(w).alias("turn"), F.count("*").over(W.partitionBy("session_key")).alias("n"),
        F.coalesce(F.try_divide(thinking, thinking + text), F.lit(0.0)).alias("thinking_ratio"), entropy.alias("tool_diversity"),
        F.log1p(text).alias("text_length"), F.col("corrected").alias("correction"), F.coalesce("failure", F.lit(0.0)).alias("tool_failure"),
    )
    return rows.where(F.col("n") >= least).drop("n")


def granger_p(cause: np.ndarray, effect: np.ndarray, lag: int) -> float | None:
    """P value of the F test that lags of the cause explain the effect beyond its own lags."""
    if min(cause.std(ddof=1), effect.std(ddof=1)) < 1e-6 or lag < 1:
        return None
    y = effect[lag:]
    own = np.column_stack([np.ones(len(y)), *(effect[lag - k : -k] for k in range(1, lag + 1))])
    both = np.column_stack([own, *(cause[lag - k : -k] for k in range(1, lag + 1))])
    free = len(y) - both.shape[1]
    if free <= 0:
        return None
    (small, _), (full, _) = stats.ols_ssr(own, y), stats.ols_ssr(both, y)
    if full <= 1e-12:
        return None
    return stats.f_sf((small - full) / lag / (full / free), lag, free)


def granger_pairs(features: DataFrame, series=SERIES) -> DataFrame:
    """``session_key, cause, effect, p`` of every ordered pair, session by session."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        lag = min(5, len(pdf) // 2 - 1)
        rows = [(pdf.session_key.iloc[0], a, b, granger_p(pdf[a].to_numpy(float), pdf[b].to_numpy(float), lag)) for a, b in itertools.permutations(series, 2)]
        return pd.DataFrame([r for r in rows if r[3]], columns=["session_key", "cause", "effect", "p"])

    return features.groupBy("session_key").applyInPandas(test, "session_key string, cause string, effect string, p double")


def poisson_below(k: Column, mean: Column) -> Column:
    """P(X < k) of a Poisson variable, for whole k of 1 or more and a positive mean.

    The largest of the k terms comes from Loader's form, which keeps its digits for
    any mean; the others follow outwards by their ratios, as far as they are above
    e^-50 of it: some 24 square roots of the mean, however large k is.
    """
    top = F.least(k.cast("bigint") - 1, F.floor(mean))
    reach = F.ceil(12 * F.sqrt(mean) + 64)
    x = F.greatest(top, F.lit(1)).cast("double")
    over = (mean - x) / x
    stirling = 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    largest = F.when(top < 16, top * F.log(mean) - mean - F.log(F.factorial(F.least(top, F.lit(16)).cast("int")).cast("double")))
    largest = largest.otherwise(-x * (over - F.log1p(over)) - F.log(2 * math.pi * x) / 2 - stirling)

    def outwards(steps: Column, ratio) -> Column:
        start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
        return F.aggregate(F.sequence(F.lit(0).cast("bigint"), steps), start, lambda acc, j: F.struct((acc["term"] * ratio(j)).alias("term"), (acc["total"] + acc["term"]).alias("total")), lambda acc: acc["total"])

    down = outwards(F.least(top, reach), lambda j: (top - j) / mean)
    up = outwards(F.least(k.cast("bigint") - 1 - top, reach), lambda j: mean / (top + j + 1))
    return F.least(F.lit(1.0), F.exp(largest) * (down + up - 1))


def fisher_combined(pairs: DataFrame) -> DataFrame:
    """Fisher's combination over sessions with Bonferroni's factor, in SQL.

    With 2k degrees of freedom the tail of chi-squared is a Poisson sum, which is
    taken exactly for any number of sessions.  A null p counts as a session and
    adds nothing to the sum.
    """
    log = F.when(F.col("p").isNotNull(), F.log(F.greatest("p", F.lit(1e-300))))
    by = pairs.groupBy("cause", "effect").agg(F.count("*").alias("k"), F.greatest(-F.sum(log), F.lit(1e-300)).alias("half"))
    by = by.withColumn("tail", poisson_below(F.col("k"), F.col("half")))
    return by.select("cause", "effect", F.col("k").alias("sessions"), F.least(F.lit(1.0), F.col("tail") * F.count("*").over(W.partitionBy())).alias("p_corrected"))


@technique("granger-causality", needs=("messages", "tool_calls", "tool_results"))
def granger_causality(frames: Frames) -> TechniqueResult:
    """Granger causality between five series of a session's turns."""
    features = granger_features(frames)
    table = fisher_combined(granger_pairs(features))
    name = F.concat_ws(" -> ", "cause", "effect")
    row = table.agg(
        F.count_if(F.col("p_corrected") < 0.05).alias("significant_pairs"), F.min_by(name, F.struct("p_corrected", name)).alias("strongest_pair"), F.min("p_corrected").alias("strongest_pair_p"),
        F.coalesce(F.bool_or((F.col("cause") == "thinking_ratio") & (F.col("effect") == "correction") & (F.col("p_corrected") < 0.05)), F.lit(False)).alias("thinking_causes_correction"),
    )
    counted = features.agg(F.count_distinct("session_key").alias("sessions_analyzed"))
    out = table.select(F.col("cause").alias("Cause"), F.col("effect").alias("Effect"), F.col("p_corrected").alias("Corrected P-Value"), (F.col("p_corrected") < 0.05).alias("Is Significant"))
    return TechniqueResult("granger_causality", {"Granger Causality Results": out}, union(findings_of("granger_causality", row), findings_of("granger_causality", counted)))


# --- proportional hazards ---


def survival_covariates(frames: Frames, times: DataFrame) -> DataFrame:
    """``duration, event`` and covariates: first prompt, early tools, thinking, session type dummies."""
    first = frames.messages.where("msg_idx = 0 and role = 'User'").select("session_key", F.length("text").cast("double").alias("first_prompt_len"))
    w = W.partitionBy("session_key").orderBy("msg_idx")
    early = frames.messages.where("role = 'Assistant'").withColumn("i", F.row_number().over(w)).where("i <= 5").groupBy("session_key").agg(F.sum("n_tool_calls").cast("double").alias("early_tools"))
    thought = frames.messages.groupBy("session_key").agg(F.bool_or(F.length("thinking") > 0).cast("double").alias("has_thinking"))
    kinds = [F.coalesce((F.col("session_type") == k).cast("double"), F.lit(0.0)).alias(f"type_{k.lower()}") for k in ("Interactive", "Subagent", "Unknown")]
    rows = times.join(frames.sessions.select("session_key", *kinds), "session_key")
    for df in (first, early, thought):
        rows = rows.join(df, "session_key", "left")
    return rows.drop("session_key").na.fill(0.0)


def cox_fit(x: np.ndarray, t: np.ndarray, event: np.ndarray, ridge: float = 1e-6, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, standard errors and concordance; Newton steps on Efron's partial likelihood."""
    order = np.argsort(-t, kind="stable")
    x, t, event = x[order], t[order], event[order].astype(bool)
    beta = np.zeros(x.shape[1])
    times = np.unique(t[event])[::-1]
    for _ in range(rounds):
        risk = np.exp(np.clip(x @ beta, -50, 50))
        s0, s1 = np.cumsum(risk), np.cumsum(risk[:, None] * x, axis=0)
        s2 = np.cumsum(risk[:, None, None] * x[:, :, None] * x[:, None, :], axis=0)
        gradient, hessian = np.zeros(len(beta)), ridge * np.eye(len(beta))
        for u in times:
            end = np.searchsorted(-t, -u, "right") - 1
            dead = np.flatnonzero(event & (t == u))
            d0, d1 = risk[dead].sum(), (risk[dead, None] * x[dead]).sum(axis=0)
            d2 = (risk[dead, None, None] * x[dead, :, None] * x[dead, None, :]).sum(axis=0)
            gradient += x[dead].sum(axis=0)
            for k in range(len(dead)):
                f = k / len(dead)
                z0, z1 = s0[end] - f * d0, s1[end] - f * d1
                gradient -= z1 / z0
                hessian += (s2[end] - f * d2) / z0 - np.outer(z1, z1) / z0**2
        step = np.linalg.solve(hessian, gradient - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    score = x @ beta
    hits = pairs = 0.0
    for i in np.flatnonzero(event):
        later = (t > t[i]) | ((t == t[i]) & ~event)
        pairs += later.sum()
        hits += (score[later] < score[i]).sum() + 0.5 * (score[later] == score[i]).sum()
    return beta, np.sqrt(np.diag(np.linalg.inv(hessian))), float(hits / pairs) if pairs else 0.5


def risk_sums(rows: DataFrame, names: list[str], beta: np.ndarray) -> pd.DataFrame:
    """One row a time: sums of risk, risk times covariates and their products, over all and over those with the event."""
    eta = sum((float(b) * F.col(c) for c, b in zip(names, beta, strict=True)), F.lit(0.0))
    r = F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), eta)))
    terms = [r, *(r * F.col(c) for c in names), *(r * F.col(a) * F.col(b) for a in names for b in names)]
    dead = lambda x: F.sum(F.when(F.col("event"), x).otherwise(0.0))
    sums = [*(F.sum(x).alias(f"s{i}") for i, x in enumerate(terms)), *(dead(x).alias(f"d{i}") for i, x in enumerate(terms)), *(dead(F.col(c)).alias(f"x{i}") for i, c in enumerate(names))]
    return rows.groupBy("duration").agg(F.count_if("event").alias("dead"), *sums).toPandas().sort_values("duration", ascending=False)


def concordance_of(cells: pd.DataFrame) -> float:
    """Share of comparable pairs in order, ties half, from ``duration, event, score, n``."""
    scores, place = np.unique(cells.score.to_numpy(float), return_inverse=True)
    cells = cells.assign(place=place)
    tree = [0] * (len(scores) + 1)

    def below(i: int) -> int:
        out = 0
        while i:
            out += tree[i]
            i -= i & -i
        return out

    hits = pairs = seen = 0
    for _, same in cells.sort_values("duration", ascending=False).groupby("duration", sort=False):
        for event in (False, True):  # those censored at a time outlive its events
            some = same[same.event == event]
            if event:
                for i, n in zip(some.place.tolist(), some.n.tolist(), strict=True):
                    less = below(i)
                    pairs += n * seen
                    hits += n * (less + 0.5 * (below(i + 1) - less))
            for i, n in zip(some.place.tolist(), some.n.tolist(), strict=True):
                seen += n
                i += 1
                while i < len(tree):
                    tree[i] += n
                    i += i & -i
    return hits / pairs if pairs else 0.5


def cox_regression(rows: DataFrame, ridge: float = 1e-6, rounds: int = 50) -> tuple[DataFrame, float | None]:
    """Covariate table and concordance of all sessions; a failure is a row of its own.

    A Newton step takes one row a distinct time to the driver, the concordance
    one a distinct time and covariates.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c not in ("duration", "event")]
    size = rows.agg(F.count("*").alias("n"), F.count_if("event").alias("dead"), *(f(c).alias(f"{k}_{c}") for c in names for k, f in (("mean", F.avg), ("sd", F.stddev_samp)))).first()
    used = [c for c in names if (size[f"sd_{c}"] or 0.0) > 1e-9]
    try:
        if size.n < 10 or not size.dead or not used:
            raise ValueError("insufficient data")
        z = rows.select("duration", "event", *(((F.col(c) - F.lit(size[f"mean_{c}"])) / F.lit(size[f"sd_{c}"])).alias(c) for c in used)).persist()
        p, beta = len(used), np.zeros(len(used))
        for _ in range(rounds):
            by = risk_sums(z, used, beta)
            s, d = (by[[f"{k}{i}" for i in range(1 + p + p * p)]].to_numpy(float) for k in "sd")
            s = s.cumsum(axis=0)
            x = by[[f"x{i}" for i in range(p)]].to_numpy(float)
            gradient, hessian = x.sum(axis=0), ridge * np.eye(p)
            for at in np.flatnonzero(by.dead.to_numpy()):
                m = int(by.dead.iloc[at])
                f = np.arange(m) / m
                z0 = s[at, 0] - f * d[at, 0]
                z1 = (s[at, 1 : p + 1] - f[:, None] * d[at, 1 : p + 1]) / z0[:, None]
                gradient = gradient - z1.sum(axis=0)
                hessian = hessian + ((1 / z0).sum() * s[at, p + 1 :] - (f / z0).sum() * d[at, p + 1 :]).reshape(p, p) - z1.T @ z1
            step = np.linalg.solve(hessian, gradient - ridge * beta)
            beta = beta + step
            if np.abs(step).max() < 1e-8:
                break
        error = np.sqrt(np.diag(np.linalg.inv(hessian)))
        cells = z.groupBy("duration", "event", *used).agg(F.count("*").alias("n")).toPandas()
        concordance = concordance_of(cells.assign(score=(cells[used].to_numpy(float) * beta).sum(axis=1)))
        z.unpersist()
        out = [(c, float(b), float(math.exp(b)), float(e), float(math.erfc(abs(b / e) / math.sqrt(2)))) for c, b, e in zip(used, beta, error, strict=True)]
        return spark.createDataFrame(out, "covariate string, coef double, hazard_ratio double, se double, p double"), round(concordance, 4)
    except (ValueError, np.linalg.LinAlgError) as failed:
        return spark.createDataFrame([(str(failed),)], "error string"), None


# --- alignments ---


def pair_scores(strings: DataFrame, score, out: str) -> DataFrame:
    """``a, b, <out>`` for every pair of a sample of ``SAMPLE`` strings, as the method samples them."""
    few = sampled(strings, "session_key", SAMPLE)
    a, b = few.select(F.col("session_key").alias("a"), F.col("s").alias("sa")), few.select(F.col("session_key").alias("b"), F.col("s").alias("sb"))

    @F.pandas_udf("double")
    def value(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([score(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    return a.join(b, F.col("a") < F.col("b")).select("a", "b", value("sa", "sb").alias(out))


def alignment_score(a: str, b: str) -> float:
    return stats.smith_waterman(a, b) / max(1, min(len(a), len(b)))


def compression_distance(a: str, b: str) -> float:
    c = lambda s: len(zlib.compress(s.encode(), 9))
    x, y = c(a), c(b)
    return (min(c(a + b), c(b + a)) - min(x, y)) / max(x, y)


def matrix_of(pairs: DataFrame, value: str, same: float) -> tuple[list[str], np.ndarray]:
    rows = pairs.collect()  # SAMPLE * (SAMPLE - 1) / 2 rows
    names = sorted({r.a for r in rows} | {r.b for r in rows})
    at = {n: i for i, n in enumerate(names)}
    m = np.full((len(names), len(names)), same)
    for r in rows:
        m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = r[value]
    return names, m


def agent_symbols(frames: Frames) -> DataFrame:
    """Symbol string of each session: C U for users, T R G E W B S X for agents, U for an agent's text alone."""
    low = F.lower("name")
    tool = F.when(low == "read", "R").when(low.isin("glob", "grep"), "G").when(low == "edit", "E").when(low == "write", "W").when(low == "bash", "B").when(low == "skill", "S").otherwise("X")
    called = frames.tool_calls.groupBy("session_key", "msg_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("call_idx", tool.alias("c")))), lambda x: x["c"]), "").alias("tools"))
    rows = frames.messages.where("role in ('User', 'Assistant')").join(called, ["session_key", "msg_idx"], "left")
    thought = F.when(F.coalesce(F.length("thinking"), F.lit(0)) > 0, "T").otherwise("")
    s = F.when(F.col("role") == "User", F.when(F.col("classification") == "HumanCorrection", "C").otherwise("U")).otherwise(F.concat(thought, F.coalesce("tools", F.lit("U"))))
    return rows.groupBy("session_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", s.alias("c")))), lambda x: x["c"]), "").alias("s"))


@technique("smith-waterman", needs=("messages", "tool_calls"))
def smith_waterman(frames: Frames) -> TechniqueResult:
    """Local alignments, conserved motifs and their enrichment."""
    spark = frames.sessions.sparkSession
    strings = sampled(agent_symbols(frames), "session_key", SAMPLE)
    count = strings.count()
    if count < 5:
        return TechniqueResult("smith_waterman", {}, one_row(spark, "smith_waterman", {"session_count": count}))
    names, score = matrix_of(pair_scores(strings, alignment_score, "score"), "score", 1.0)
    labels = stats.cut(stats.average_linkage(1 - np.minimum(score, 1)), len(names), height=0.5)
    corrections = strings.select("session_key", (F.length("s") - F.length(F.replace("s", F.lit("C")))).alias("c"))
    middle = corrections.agg(F.percentile("c", F.lit(0.5)).alias("m"))
    groups = corrections.join(F.broadcast(middle)).select("session_key", (F.col("c") > F.col("m")).alias("high"))
    motifs = process.conserved_kmers(strings)
    rich = process.kmer_enrichment(strings, groups).withColumnsRenamed({"low_freq": "low_correction_freq", "high_freq": "high_correction_freq"})
    rich = rich.withColumn("group", F.when(F.col("enrichment_ratio") > 2, "high_correction").when(F.col("enrichment_ratio") < 0.5, "low_correction")).where("`group` is not null")
    upper = score[np.triu_indices(len(names), 1)]
    ends = rich.agg(F.min_by("motif", F.struct("enrichment_ratio", "motif")).alias("top_success_motif"), F.max_by("motif", F.struct("enrichment_ratio", "motif")).alias("top_struggle_motif"))
    own = one_row(spark, "smith_waterman", {"mean_alignment_score": round(float(upper.mean()), 4), "conserved_motifs_count": motifs.count(), "cluster_count": len(set(labels.tolist()))})
    tables = {"Conserved Motifs": motifs.orderBy(F.desc("frequency"), "motif").limit(20), "Motif Enrichment": rich.orderBy(F.desc(F.greatest("enrichment_ratio", 1 / F.col("enrichment_ratio"))), "motif").limit(20)}
    return TechniqueResult("smith_waterman", tables, union(own, findings_of("smith_waterman", ends)))


@technique("ncd-clustering", needs=("messages", "tool_calls", "tool_results"))
def ncd_clustering(frames: Frames) -> TechniqueResult:
    """Clusters of sessions by normalised compression distance."""
    spark = frames.sessions.sparkSession
    strings = stream_symbols(frames)
    kept = sampled(strings.where(F.length("s") >= 8), "session_key", SAMPLE)
    rows = {r.session_key: r.s for r in kept.collect()}
    skipped = strings.where(F.length("s") < 8).count()
    if len(rows) < 5:
        return TechniqueResult("ncd_clustering", {}, one_row(spark, "ncd_clustering", {"sessions_in_sample": len(rows), "sessions_skipped": skipped}))
    names, distance = matrix_of(pair_scores(kept, compression_distance, "ncd"), "ncd", 0.0)
    merges = stats.average_linkage(distance)
    tried = [(stats.silhouette(distance, labels), -k, labels) for k in range(3, 9) if k < len(names) for labels in [stats.cut(merges, len(names), clusters=k)]]
    best, k, labels = max(tried, key=lambda x: x[:2])
    rate = {r.session_key: r.rate for r in process.cohorts(frames).join(kept.select("session_key"), "session_key").collect()}
    table = []
    for c in range(-k):
        own = [n for n, x in zip(names, labels, strict=True) if x == c]
        if not own:
            continue
        text = "".join(rows[n] for n in own)
        middle = float(np.median([len(rows[n]) for n in own]))
        chosen = min(own, key=lambda n: (abs(len(rows[n]) - middle), n))
        table.append((c, len(own), min(set(text), key=lambda s: (-text.count(s), s)), float(np.mean([len(rows[n]) for n in own])), float(np.mean([rate.get(n, 0.0) for n in own])), rows[chosen][:60]))
    summary = spark.createDataFrame(table, "cluster_id int, size int, dominant_symbol string, mean_length double, mean_correction_rate double, representative string")
    most = max(table, key=lambda r: (r[1], -r[0]))
    first = names[:10]
    preview = spark.createDataFrame([(n, *(float(distance[i, j]) for j in range(len(first)))) for i, n in enumerate(first)], "session_id string, " + ", ".join(f"s{j + 1} double" for j in range(len(first))))
    findings = one_row(spark, "ncd_clustering", {"sessions_in_sample": len(names), "sessions_skipped": skipped, "optimal_k": -k, "silhouette_score": round(best, 4), "largest_cluster_size": most[1], "largest_cluster_label": most[0]})
    return TechniqueResult("ncd_clustering", {"Cluster Summary": summary, "NCD Matrix Preview": preview}, findings)


def stream_symbols(frames: Frames) -> DataFrame:
    """Symbol stream of each session: U u C for users, T and tools, F for failed results, A for text alone."""
    name = F.col("name")
    tool = F.when(name == "Read", "R").when(name.isin("Glob", "Grep"), "G").when(name == "Edit", "E").when(name == "Write", "W").when(name == "Bash", "B").when(name == "Skill", "S").otherwise("X")
    called = frames.tool_calls.groupBy("session_key", "msg_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("call_idx", tool.alias("c")))), lambda x: x["c"]), "").alias("tools"))
    failed = frames.tool_results.groupBy("session_key", "msg_idx").agg(F.bool_or(F.coalesce("is_error", F.lit(False))).alias("failed"))
    rows = frames.messages.where("role in ('User', 'Assistant')").join(called, ["session_key", "msg_idx"], "left").join(failed, ["session_key", "msg_idx"], "left")
    user = F.concat(F.when(F.length("text") >= 200, "U").otherwise("u"), F.when(F.col("classification") == "HumanCorrection", "C").otherwise(""))
    thought = F.coalesce(F.length("thinking") > 0, F.lit(False))
    agent = F.concat(F.when(thought, "T").otherwise(""), F.coalesce("tools", F.lit("")), F.when(F.coalesce("failed", F.lit(False)), "F").otherwise(""), F.when(F.col("tools").isNull() & ~thought, "A").otherwise(""))
    s = F.when(F.col("role") == "User", user).otherwise(agent)
    return rows.groupBy("session_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", s.alias("c")))), lambda x: x["c"]), "").alias("s"))


# --- time patterns by permutation ---


def observed_within(codes: np.ndarray, n: int, window: int = 5) -> np.ndarray:
    """Counts (n x n) of pairs whose second follows within ``window`` places."""
    out = np.zeros((n, n), np.int64)
    for k in range(1, window + 1):
        out += np.bincount(codes[:-k].astype(np.int64) * n + codes[k:], minlength=n * n).reshape(n, n)
    return out


def shuffled_moments(sizes: list[int], window: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Exact mean and deviation (n x n) of :func:`observed_within` over all orders of the codes, from how often each occurs."""
    total = sum(sizes)
    fall = lambda n, k: math.prod(n - i for i in range(k))
    edge = min(window, total)  # places with fewer than ``window`` others on one side
    pairs = sum(total - k for k in range(1, min(window, total - 1) + 1))
    ends = lambda f: f(window) * max(0, total - edge) + sum(f(min(window, i)) for i in range(edge))
    same = ends(lambda d: d * (d - 1))  # ordered couples of pairs with one first place; as many share the second
    if total > 2 * window:
        chain = 2 * (window * window * (total - 2 * window) + 2 * window * sum(range(window)))
    else:
        chain = 2 * sum(min(window, i) * min(window, total - 1 - i) for i in range(total))
    apart = pairs * pairs - pairs - 2 * same - chain
    share = lambda n, k: Fraction(n, fall(total, k)) if n else Fraction(0)
    mean, sd = (np.zeros((len(sizes), len(sizes))) for _ in range(2))
    for (i, a), (j, b) in itertools.product(enumerate(sizes), repeat=2):
        if i == j:
            first, square = pairs * share(fall(a, 2), 2), pairs * share(fall(a, 2), 2) + (2 * same + chain) * share(fall(a, 3), 3) + apart * share(fall(a, 4), 4)
        else:
            first, square = pairs * share(a * b, 2), pairs * share(a * b, 2) + same * share(a * b * (b - 1) + a * (a - 1) * b, 3) + apart * share(a * (a - 1) * b * (b - 1), 4)
        mean[i, j], sd[i, j] = float(first), math.sqrt(max(Fraction(0), square - first * first))
    return mean, sd


def significant(seen: np.ndarray, sizes: list[int], names: list[str], window: int = 5, sigmas: float = 2.5) -> list[tuple]:
    """``pattern, observed, expected, z`` of pairs above mean + 2.5 deviations over all permutations."""
    n = len(names)
    mean, sd = shuffled_moments(sizes, window)
    z = np.where(sd > 0, (seen - mean) / np.where(sd > 0, sd, 1), np.where(seen > mean, np.inf, -np.inf))
    return [(f"{names[i]}->{names[j]}", int(seen[i, j]), float(mean[i, j]), float(z[i, j])) for i in range(n) for j in range(n) if seen[i, j] > mean[i, j] + sigmas * sd[i, j]]


def significant_pairs(codes: np.ndarray, names: list[str], window: int = 5, sigmas: float = 2.5) -> list[tuple]:
    """:func:`significant` of one sequence."""
    return significant(observed_within(codes, len(names), window), np.bincount(codes, minlength=len(names)).tolist(), names, window, sigmas)


@technique("tpattern-detection", needs=("messages", "tool_calls", "tool_results"))
def tpattern_detection(frames: Frames, intended: bool = False) -> TechniqueResult:
    """Pairs of events that follow each other more than by chance, and chains of two such pairs."""
    spark = frames.sessions.sparkSession
    log = process.pattern_codes(frames, intended).join(frames.sessions.select("session_key", "session_ord"), "session_key")
    return tpatterns_of(log, spark)


def lagged_counts(log: DataFrame, names: list[str], window: int = 5) -> tuple[np.ndarray, Counter]:
    """:func:`observed_within` and the counts of three in a row, over all of ``session_ord, pos, symbol``.

    Partitions are ranges of the whole order; each returns its counts and the
    codes at its two ends, from which pairs across partitions are added.
    """
    n = len(names)
    at = {x: i for i, x in enumerate(names)}
    edge = max(window, 2)

    def count(batches):
        pair, three, head, tail = np.zeros((n, n), np.int64), Counter(), [], np.zeros(0, np.int64)
        for pdf in batches:
            codes = pdf.symbol.map(at).to_numpy(np.int64)
            head += codes[: edge - len(head)].tolist()
            across(pair, three, tail, codes)
            tail = np.concatenate([tail, codes])[-edge:]
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "found": [pickle.dumps((pair, three, head, tail.tolist()))]})

    def across(pair, three, tail, codes):
        """Adds what ends in ``codes`` and may begin in the ``tail`` before it."""
        both, skip = np.concatenate([tail, codes]), len(tail)
        for k in range(1, window + 1):
            a, b = both[max(0, skip - k) : len(both) - k], both[max(k, skip) :]
            np.add.at(pair, (a, b), 1)
        begin = max(0, skip - 2)
        ids, times = np.unique((both[begin:-2] * n + both[begin + 1 : -1]) * n + both[begin + 2 :], return_counts=True) if len(both) - begin > 2 else ([], [])
        for i, t in zip(ids, times, strict=True):
            three[int(i)] += int(t)

    rows = log.select("session_ord", "pos", "symbol").repartitionByRange("session_ord", "pos").sortWithinPartitions("session_ord", "pos")
    pair, three, tail = np.zeros((n, n), np.int64), Counter(), np.zeros(0, np.int64)
    for row in sorted(rows.mapInPandas(count, "part int, found binary").collect(), key=lambda r: r.part):  # one row a partition
        own, chains, head, last = pickle.loads(bytes(row.found))
        pair += own
        three.update(chains)
        across(pair, three, tail, np.array(head, np.int64))
        inside, again = np.zeros((n, n), np.int64), Counter()  # pairs inside the head are in the partition's own counts
        across(inside, again, np.zeros(0, np.int64), np.array(head, np.int64))
        pair -= inside
        three.subtract(again)
        tail = np.concatenate([tail, np.array(last, np.int64)])[-edge:]
    return pair, three


def tpatterns_of(log: DataFrame, spark) -> TechniqueResult:
    """Over all of ``session_ord, pos, symbol``, sessions in sequence; counts reach the driver, not events."""
    by = {r.symbol: r.n for r in log.groupBy("symbol").agg(F.count("*").alias("n")).collect()}  # one row a symbol
    names, total = sorted(by), sum(by.values())
    if total < 10 or log.select("session_ord").distinct().limit(3).count() < 3:
        return TechniqueResult("tpattern_detection", {}, one_row(spark, "tpattern_detection", {"total_events_analyzed": total}))
    seen, triples = lagged_counts(log, names)
    one = significant(seen, [by[x] for x in names], names)
    z = {p: v for p, _, _, v in one}
    n = len(names)
    two = []
    for p, q in itertools.product(z, z):
        (a, b), (b2, c) = p.split("->"), q.split("->")
        count = triples[(names.index(a) * n + names.index(b)) * n + names.index(c)] if b == b2 else 0
        if count:
            two.append((f"{a}->{b}->{c}", count, min(z[p], z[q])))
    t1 = spark.createDataFrame(one, "pattern string, observed_count bigint, expected_count double, z_score double")
    t2 = spark.createDataFrame(two, "pattern string, observed_count bigint, z_score double")
    top = max(one, key=lambda r: (r[1], r[0]), default=(None,))[0]
    findings = one_row(spark, "tpattern_detection", {"level_1_patterns": len(one), "level_2_patterns": len(two), "most_common_pattern": top, "total_events_analyzed": total})
    return TechniqueResult("tpattern_detection", {"T-Patterns Level 1": t1, "T-Patterns Level 2": t2}, findings)


# --- adoption curves ---


def least_squares(f, p: np.ndarray, low: np.ndarray, high: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Levenberg-Marquardt with box bounds and numeric derivatives; parameters and residual sum of squares."""
    p, damp = np.clip(p, low, high), 1e-2
    r = y - f(p)
    for _ in range(rounds):
        h = 1e-6 * np.maximum(1, np.abs(p))
        j = np.array([(f(np.clip(p + h * e, low, high)) - f(np.clip(p - h * e, low, high))) / max(1e-12, (np.clip(p + h * e, low, high) - np.clip(p - h * e, low, high)) @ e) for e in np.eye(len(p))]).T
        a = j.T @ j
        step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), j.T @ r, rcond=None)[0]
        q = np.clip(p + step, low, high)
        s = y - f(q)
        if s @ s < r @ r:
            done = abs(r @ r - s @ s) < 1e-10 * max(1e-12, r @ r)
            p, r, damp = q, s, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e10:
                break
    return p, float(r @ r)


def sir_curve(beta: float, gamma: float, n: float, steps: int) -> np.ndarray:
    """Cumulative infected of the SIR model by fourth-order steps."""
    s, i, out = n - 1.0, 1.0, []
    b = beta / n
    for _ in range(steps):
        out.append(n - s)
        f = b * s * i
        s1, i1 = -f, f - gamma * i
        x, y = s + s1 / 2, i + i1 / 2
        f = b * x * y
        s2, i2 = -f, f - gamma * y
        x, y = s + s2 / 2, i + i2 / 2
        f = b * x * y
        s3, i3 = -f, f - gamma * y
        x, y = s + s3, i + i3
        f = b * x * y
        s, i = s + (s1 + 2 * s2 + 2 * s3 - f) / 6, i + (i1 + 2 * i2 + 2 * i3 + f - gamma * y) / 6
    return np.array(out)


def fit_adoption(rank: np.ndarray, adopters: np.ndarray) -> tuple[str, float, float, float]:
    """Better model (logistic on ties), R2, its rate and its inflection or peak."""
    n, y = float(adopters.max()), adopters.astype(float)
    total = float(((y - y.mean()) ** 2).sum())
    if total <= 0 or len(y) < 4:
        return "none", 0.0, 0.0, 0.0
    t = rank.astype(float)
    logistic = lambda p: p[0] / (1 + np.exp(-np.clip(p[1] * (t - p[2]), -50, 50)))
    top = float(t.max())
    p, s = least_squares(logistic, np.array([n, 4 / max(1.0, top), float(np.median(t))]), np.array([1.0, 0.0, 0.0]), np.array([max(n, 1.0), 5.0, top]), y)
    steps = len(y)
    sir = lambda q: sir_curve(q[0], q[1], n, steps)
    q, u = least_squares(sir, np.array([0.5, 0.1]), np.array([0.01, 0.01]), np.array([5.0, 5.0]), y)
    r_log, r_sir = 1 - s / total, 1 - u / total
    if r_log >= r_sir:
        return "logistic", r_log, float(p[1]), float(p[2])
    return "sir", r_sir, float(q[0]), float(np.argmax(np.diff(sir(q))))


def adoption_fits(curves: DataFrame) -> DataFrame:
    """One fit a bigram of ``bigram, rank, adopters``."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        model, r2, rate, turn = fit_adoption(pdf["rank"].to_numpy(), pdf.adopters.to_numpy())
        middle = turn / max(1, int(pdf["rank"].max()))
        shape = "unfitted" if r2 <= 0.7 else "early" if middle < 1 / 3 else "late" if middle > 2 / 3 else "steady"
        return pd.DataFrame([(pdf.bigram.iloc[0], int(pdf.adopters.max()), model, r2, rate, turn, shape)], columns=["bigram", "n_adopters", "best_model", "r2", "k_or_beta", "inflection_or_peak", "trajectory_class"])

    return curves.groupBy("bigram").applyInPandas(fit, "bigram string, n_adopters bigint, best_model string, r2 double, k_or_beta double, inflection_or_peak double, trajectory_class string")


@technique("convention-epidemiology", needs=("sessions", "messages", "tool_calls"))
def convention_epidemiology(frames: Frames) -> TechniqueResult:
    """Adoption of tool bigrams over sessions and across projects."""
    dated = trends.dated_sessions(frames)
    some = dated.where("ts is not null")
    dated = some if some.limit(1).count() else dated.join(frames.sessions.select("session_key", "session_ord"), "session_key").withColumn("ts", F.timestamp_seconds(F.col("session_ord") * 86400)).drop("session_ord")
    n = dated.count()
    spark = frames.sessions.sparkSession
    if n < 15:
        return TechniqueResult("convention_epidemiology", {}, one_row(spark, "convention_epidemiology", {"sessions_analyzed": n}))
    pairs = trends.session_pairs(frames.tool_calls)
    candidates = trends.convention_candidates(pairs, n)
    kept = pairs.join(F.broadcast(candidates.select("bigram")), "bigram")  # in a tenth of all sessions each, so few
    ranked = trends.ranked_sessions(dated)
    fits = adoption_fits(trends.adoption_curves(kept, ranked))
    # A session's project is that of its working folder; where logs have none, the name the source gives.
    folder = frames.sessions.select("session_key", project_id(F.col("cwd")).alias("folder"))
    other = F.when(F.col("project") != "(unknown)", P.redacted(F.col("project")))
    named = dated.join(folder, "session_key", "left").withColumn("project", F.coalesce("folder", other)).drop("folder").where("project is not null")
    projects = named.select("project").distinct().count()
    spread = trends.propagation(kept, named, max(1, projects)) if projects >= 3 else trends.propagation(kept, named, 1).where("false")
    pattern = F.when(F.col("reach") > 0.8, "ubiquitous").when(F.col("reach") <= 0.2, "confined").when(F.col("median_latency_days") <= 1, "radial").when(F.col("median_latency_days") >= 7, "sequential").otherwise("diffuse")
    spread = spread.withColumn("propagation_pattern", pattern)
    seen = kept.join(named, "session_key").groupBy("bigram", "project").agg(F.min("ts").alias("first_seen_timestamp"))
    latency = (F.unix_micros("first_seen_timestamp") - F.unix_micros(F.min("first_seen_timestamp").over(W.partitionBy("bigram")))) / 86_400e6
    grid = seen.withColumn("latency_days_from_origin", latency).orderBy("bigram", "project").limit(100).withColumnRenamed("project", "project_id")
    best = fits.agg(
        F.count("*").alias("conventions_detected"), F.count_if(F.col("r2") > 0.7).alias("conventions_fitted"), F.max_by("bigram", F.struct("r2", "bigram")).alias("top_convention"),
        F.max("r2").alias("top_convention_r2"), F.count_if((F.col("best_model") == "sir") & (F.col("r2") > 0.7)).alias("epidemic_conventions"),
    )
    crossed = spread.agg(
        F.count_if(F.col("n_projects") > 1).alias("cross_project_conventions"), *(F.count_if(F.col("propagation_pattern") == k).alias(f"{k}_conventions") for k in ("ubiquitous", "radial", "sequential")),
        F.max_by("bigram", F.struct("reach", "bigram")).alias("top_cross_project_convention"), F.max("reach").alias("top_cross_project_reach"), F.avg("median_latency_days").alias("mean_inter_project_latency_days"),
    )
    sizes = one_row(spark, "convention_epidemiology", {"sessions_analyzed": n, "projects_detected": projects})
    tables = {"Within-Workflow Fits": fits, "Cross-Project Propagation": spread.withColumnRenamed("n_projects", "n_projects_adopted").withColumnRenamed("origin", "origin_project"), "Convention × Project Matrix": grid}
    return TechniqueResult("convention_epidemiology", tables, union(sizes, findings_of("convention_epidemiology", best), findings_of("convention_epidemiology", crossed)))


# --- change points ---

SIGNALS = ("user_msg_length", "tool_call_rate", "correction_flag", "tool_diversity")


def user_turn_signals(frames: Frames, least: int = 30) -> DataFrame:
    """Four signals over user messages; what the assistant did counts for the first user message after it only."""
    w = W.partitionBy("session_key").orderBy("msg_idx")
    tools = frames.tool_calls.groupBy("session_key", "msg_idx").agg(F.count("*").alias("n"), F.count_distinct("name").alias("kinds"))
    rows = frames.messages.withColumn("size", F.count("*").over(W.partitionBy("session_key"))).where(F.col("size") >= least).join(tools, ["session_key", "msg_idx"], "left").na.fill(0, ["n", "kinds"])
    rows = rows.where("role in ('User', 'Assistant')").withColumn("before", F.lag("role").over(w))
    rows = rows.withColumns({"n_before": F.lag("n").over(w), "kinds_before": F.lag("kinds").over(w)})
    fresh = F.col("before") == "Assistant"
    return rows.where("role = 'User'").select(
        "session_key", (F.row_number().over(w) - 1).alias("i"), F.length(P.without_boilerplate(F.col("text"), strip=False)).cast("double").alias("user_msg_length"),
        F.when(fresh, F.col("n_before")).otherwise(0).cast("double").alias("tool_call_rate"), (F.col("classification") == "HumanCorrection").cast("double").alias("correction_flag"),
        F.when(fresh, F.col("kinds_before")).otherwise(0).cast("double").alias("tool_diversity"),
    )


def regimes_of(x: np.ndarray, most: int | None = 500) -> list[tuple[int, int, float]]:
    """Regimes (start, end, mean) of one signal; empty where there is nothing to analyse.

    As published, a series of more than ``most`` points is searched at every
    second, third, ... of them, so its ends are that coarse; None searches all.
    """
    if (x != 0).sum() < 10 or x.std() < 1e-10:
        return []
    step = -(-len(x) // most) if most else 1
    z = ((x - x.mean()) / x.std())[::step]
    cuts = [0, *(min(len(x), c * step) for c in stats.pelt(z, 1.5 * math.log(len(z)))), len(x)]
    return [(a, b, float(x[a:b].mean())) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def session_regimes(signals: DataFrame, names=SIGNALS, most: int | None = 500) -> DataFrame:
    """``session_key, signal, regime, start, end, mean, class``: a regime's class compares it with the one before.

    ``most`` as in ``regimes_of``.
    """

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("i"), []
        for name in names:
            x = pdf[name].to_numpy(float)
            before = None
            for k, (a, b, m) in enumerate(regimes_of(x, most)):
                slack = 0.1 * x.std()
                kind = "flat" if before is None or abs(m - before) <= slack else "rising" if m > before else "falling"
                out.append((pdf.session_key.iloc[0], name, k, a, b, m, kind))
                before = m
        return pd.DataFrame(out, columns=["session_key", "signal", "regime", "start", "end", "mean", "kind"])

    return signals.groupBy("session_key").applyInPandas(find, "session_key string, signal string, regime int, start int, end int, mean double, kind string")


@technique("change-point-detection", needs=("messages", "tool_calls"))
def change_point_detection(frames: Frames) -> TechniqueResult:
    """Change points of four signals of each long session."""
    signals = user_turn_signals(frames)
    regimes = session_regimes(signals).persist()
    w = W.partitionBy("session_key", "signal").orderBy("regime")
    cps = regimes.withColumn("prior", F.lag("mean").over(w)).where("regime > 0")
    sizes = signals.agg(F.count_distinct("session_key").alias("sessions_analyzed"))
    each = cps.agg(F.count("*").alias("total_change_points"), *(F.count_if(F.col("signal") == s).alias(f"change_points_{s}") for s in SIGNALS))
    per = each.join(F.broadcast(sizes)).select("*", F.coalesce(F.try_divide("total_change_points", "sessions_analyzed"), F.lit(0.0)).alias("mean_change_points_per_session"))
    most = cps.groupBy("session_key").agg(F.count("*").alias("n")).agg(F.min_by("session_key", F.struct(-F.col("n"), "session_key")).alias("most_volatile_session_id"))
    by = cps.groupBy("signal").agg(F.count_distinct("session_key").alias("sessions_with_cp"), F.count("*").alias("total_cps"))
    spine = cps.sparkSession.createDataFrame([(s,) for s in SIGNALS], "signal string")
    summary = spine.join(by, "signal", "left").na.fill(0).join(F.broadcast(sizes)).select("signal", "sessions_with_cp", "total_cps", F.coalesce(F.try_divide("total_cps", "sessions_analyzed"), F.lit(0.0)).alias("mean_cps_per_session"))
    points = cps.select(F.col("session_key").alias("session_id"), "signal", F.col("start").alias("index"), F.col("prior").alias("regime_before"), F.col("mean").alias("regime_after"))
    table = regimes.select(F.col("session_key").alias("session_id"), "signal", F.col("regime").alias("regime_num"), F.col("start").alias("start_index"), F.col("end").alias("end_index"), F.col("mean").alias("mean_value"), F.col("kind").alias("classification"))
    tables = {"Change Points": points.orderBy("session_id", "signal", "index").limit(500), "Regimes": table.orderBy("session_id", "signal", "regime_num").limit(1000), "Signal Summary": summary}
    return TechniqueResult("change-point-detection", tables, union(findings_of("change-point-detection", per), findings_of("change-point-detection", most)))


def rolling_features(frames: Frames, width: int = 10) -> DataFrame:
    """Tool entropy, tool rate, user text length and correction density over the last ten assistant turns, for :func:`session_regimes`."""
    w = W.partitionBy("session_key").orderBy("msg_idx")
    tools = frames.tool_calls.withColumn("category", P.tool_category(F.col("name"))).groupBy("session_key", "msg_idx").agg(F.count("*").alias("n"), *(F.count_if(F.col("category") == c).alias(c) for c in FEATURES[:6]))
    user = F.col("role") == "User"
    rows = frames.messages.select(
        "session_key", "msg_idx", "role", F.last(F.when(user, F.length("text")), True).over(w).alias("asked"),
        F.last(F.when(user, (F.col("classification") == "HumanCorrection").cast("double")), True).over(w).alias("corrected"),
    ).where("role = 'Assistant'").join(tools, ["session_key", "msg_idx"], "left").na.fill(0)
    recent = w.rowsBetween(1 - width, 0)
    sums = [F.sum(c).over(recent) for c in FEATURES[:6]]
    total = sum(sums[1:], sums[0])
    entropy = sum((F.when(x > 0, -(x / total) * F.log2(x / total)).otherwise(0.0) for x in sums), F.lit(0.0))
    return rows.select(
        "session_key", (F.row_number().over(w) - 1).alias("i"), entropy.alias("tool_entropy"), F.avg("n").over(recent).alias("tool_rate"),
        F.avg("asked").over(recent).alias("user_length"), F.avg("corrected").over(recent).alias("correction_density"),
    )


def fingerprint(symbols: str, windows: int = 10, top: int = 5, n: int = 2) -> str:
    """A stream of any length as ten windows of their five most frequent n-grams with frequencies from 0 to 9."""
    out = []
    for k in range(windows):
        part = symbols[k * len(symbols) // windows : (k + 1) * len(symbols) // windows + n - 1]
        grams: dict = {}
        for i in range(len(part) - n + 1):
            grams[part[i : i + n]] = grams.get(part[i : i + n], 0) + 1
        best = sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:top]
        total = max(1, sum(grams.values()))
        out.append("".join(f"{g}{min(9, 10 * c // total)}" for g, c in best))
    return "|".join(out)


def fingerprint_distance(a: str, b: str) -> float:
    """Compression distance of two streams' fingerprints, which does not favour equal lengths."""
    return compression_distance(fingerprint(a), fingerprint(b))


def topics(weights: pd.DataFrame, k: int = 12, rounds: int = 200, seed: int = 42) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Non-negative factors of ``doc_id, term, weight`` by multiplicative updates: documents x k, k x terms, terms."""
    table = weights.pivot_table(index="doc_id", columns="term", values="weight", fill_value=0.0)
    x, rng = table.to_numpy(float), np.random.default_rng(seed)
    w, h = rng.random((x.shape[0], k)) + 0.1, rng.random((k, x.shape[1])) + 0.1
    for _ in range(rounds):
        h *= (w.T @ x) / (w.T @ w @ h + 1e-12)
        w *= (x @ h.T) / (w @ (h @ h.T) + 1e-12)
    return w, h, [str(c) for c in table.columns]


def topic_factors(rows: DataFrame, k: int, terms: int, rounds: int = 100, inner: int = 20, seed: int = 42) -> np.ndarray:
    """Non-negative k x terms factors of all ``ids, weights`` (a document's term numbers and weights).

    Document factors never leave their partition: each round solves them from the
    current term factors by ``inner`` multiplicative updates and returns a k x terms
    and a k x k sum.
    """
    h = np.random.default_rng(seed).random((k, terms)) + 0.1
    rows = rows.persist()

    def partial(batches):
        up, gram, squares = np.zeros((k, terms)), np.zeros((k, k)), h @ h.T
        for pdf in batches:
            pdf = pdf[pdf.ids.map(len) > 0]
            if not len(pdf):
                continue
            size = pdf.ids.map(len).to_numpy()
            ids, value = np.concatenate(pdf.ids.to_list()).astype(np.int64), np.concatenate(pdf.weights.to_list())
            xh = np.add.reduceat(value[:, None] * h.T[ids], np.cumsum(size) - size)
            w = np.ones_like(xh)
            for _ in range(inner):
                w *= xh / (w @ squares + 1e-12)
            for t in range(k):
                up[t] += np.bincount(ids, value * np.repeat(w[:, t], size), terms)
            gram += w.T @ w
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "found": [pickle.dumps((up, gram))]})

    for _ in range(rounds):
        found = [pickle.loads(bytes(r.found)) for r in sorted(rows.mapInPandas(partial, "part int, found binary").collect(), key=lambda r: r.part)]  # one row a partition
        up, gram = (sum(x[1:], x[0]) for x in zip(*found, strict=True))
        after = h
        for _ in range(inner):
            after = after * up / (gram @ after + 1e-12)
        moved = np.linalg.norm(after - h) / (np.linalg.norm(h) + 1e-300)
        h = after
        if moved < 1e-4:
            break
    rows.unpersist()
    return h


def topic_terms(docs: DataFrame, k: int = 12, top: int = 8, vocabulary: int = 5000) -> DataFrame:
    """``topic, rank, term, weight`` of all documents over the most frequent terms of all of them."""
    from .corpus import tf_idf

    v = tf_idf(docs.where("text is not null").select("doc_id", "text")).persist()
    terms = v.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(vocabulary)
    names = sorted(r.term for r in terms.select("term").collect())  # at most ``vocabulary``
    if not names:
        return docs.sparkSession.createDataFrame([], "topic int, rank int, term string, weight double")
    known = docs.sparkSession.createDataFrame(list(enumerate(names)), "id int, term string")
    one = F.struct("id", "weight")
    rows = v.join(F.broadcast(known), "term").groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("x"))
    rows = rows.sortWithinPartitions("doc_id").select(F.transform("x", lambda e: e["id"]).alias("ids"), F.transform("x", lambda e: e["weight"]).alias("weights"))
    h = topic_factors(rows, k, len(names))
    v.unpersist()
    rows = [(t, r + 1, names[j], float(h[t, j])) for t in range(len(h)) for r, j in enumerate(np.lexsort((names, -h[t]))[:top])]
    return docs.sparkSession.createDataFrame(rows, "topic int, rank int, term string, weight double")


@technique("echo", needs=("sessions",))
def echo(frames: Frames) -> TechniqueResult:
    """Counts the sessions: a self-test of the technique interface."""
    row = frames.sessions.agg(F.count("*").alias("session_count"))
    return TechniqueResult("echo", {}, findings_from_rows("echo", row, F.lit("session_count"), F.col("session_count")))
