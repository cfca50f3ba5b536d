"""Counts and models over all rows against brute force, past the bounds of earlier samples."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.plans import numeric


def test_shuffled_moments_are_exact():
    for codes, window in (([0, 0, 1, 1, 2, 0], 2), ([0, 1, 1, 1, 0, 1, 2], 5), ([0, 1, 0, 0, 1, 1, 0], 3)):
        draws = np.array([numeric.observed_within(np.array(o), 3, window) for o in itertools.permutations(codes)])
        mean, sd = numeric.shuffled_moments(np.bincount(codes, minlength=3).tolist(), window)
        assert mean == pytest.approx(draws.mean(axis=0)) and sd == pytest.approx(draws.std(axis=0), abs=1e-9)


def test_time_patterns_count_all_sessions(spark):
    rng = np.random.default_rng(5)
    rows = [(o, i, "abc"[rng.integers(3)]) for o in range(5600) for i in range(1, rng.integers(2, 9))]
    log = spark.createDataFrame(pd.DataFrame(rows, columns=["session_ord", "pos", "symbol"])).withColumn("session_key", F.col("session_ord").cast("string"))
    codes = np.array(["abc".index(x) for _, _, x in rows])
    triples = np.bincount((codes[:-2] * 3 + codes[1:-1]) * 3 + codes[2:], minlength=27)
    for df in (log, log.where("session_ord < 3")):
        own = codes[: df.count()]
        pair, three = numeric.lagged_counts(df.repartition(7), ["a", "b", "c"])
        assert (pair == numeric.observed_within(own, 3)).all()
    assert (np.array([numeric.lagged_counts(log, ["a", "b", "c"])[1][i] for i in range(27)]) == triples).all()
    import json

    found = {r.label: json.loads(r.value_json) for r in numeric.tpatterns_of(log, spark).findings.collect()}
    assert found["total_events_analyzed"] == len(rows)


def test_cox_takes_all_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, (5500, 2)).astype(float)
    t = np.ceil(5 * rng.exponential(1 / np.exp(0.5 * x[:, 0]))).clip(1, 12)
    event = (t < 12) & (rng.random(5500) < 0.8)
    pdf = pd.DataFrame({"duration": t.astype(int), "event": event, "a": x[:, 0], "b": x[:, 1], "c": 1.0})
    table, concordance = numeric.cox_regression(spark.createDataFrame(pdf))
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    beta, se, want = numeric.cox_fit(z, t, event)
    got = {r.covariate: r for r in table.collect()}
    assert set(got) == {"a", "b"} and concordance == pytest.approx(want, abs=1e-4)
    assert [got[c].coef for c in "ab"] == pytest.approx(beta, abs=1e-6) and [got[c].se for c in "ab"] == pytest.approx(se, abs=1e-6)


def test_adoption_curves_are_not_thinned(spark):
    rank = np.arange(1, 1202)
    y = 1 + np.cumsum(rank % 3 == 0)
    curves = spark.createDataFrame(pd.DataFrame({"bigram": "x->y", "rank": rank, "adopters": y}))
    got = numeric.adoption_fits(curves).first()
    model, r2, rate, turn = numeric.fit_adoption(rank, y)
    assert (got.best_model, got.r2, got.k_or_beta, got.inflection_or_peak) == (model, pytest.approx(r2), pytest.approx(rate), pytest.approx(turn))


def test_hidden_states_are_fitted_on_all_sessions(spark):
    """A third behaviour that only one session in forty shows, and 1,200 sessions."""
    rng = np.random.default_rng(4)
    level = np.array([0.0, 4.0, 40.0])
    rows = []
    for k in range(1200):
        for t in range(1, 13):
            state = 2 if k % 40 == 0 else int(t > 6)
            rows.append((f"s{k}", t, *rng.normal(level[state], 0.3, len(numeric.FEATURES)), False))
    features = spark.createDataFrame(pd.DataFrame(rows, columns=["session_key", "turn", *numeric.FEATURES, "corrected"])).repartition(5)
    model = numeric.fitted_hmm(features, range(3, 4))
    assert sorted(model.mean[:, 0]) == pytest.approx(level, abs=0.1)
    local = numeric.expected(model, [g[list(numeric.FEATURES)].to_numpy(float) for _, g in pd.DataFrame(rows, columns=["session_key", "turn", *numeric.FEATURES, "corrected"]).groupby("session_key")])
    assert local[3].sum() == pytest.approx(1200 * 12) and local[0] == pytest.approx(model.loglik, abs=1)


def test_topics_take_all_documents(spark, sf_dir):
    from tracewright.plans import catalog

    themes = [["alpha", "beta", "gamma"], ["delta", "omega", "sigma"], ["kappa", "theta", "zeta"]]
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(rng.choice(themes[i % 3], 12)), "en" if i % 2 else "fr") for i in range(2600)]
    got = numeric.topic_terms(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(6), 3, top=3).collect()
    assert sorted(sorted(r.term for r in got if r.topic == t) for t in range(3)) == sorted(map(sorted, themes))
    assert {r.topic for r in catalog.QUERIES["topic_terms"](spark, sf_dir).collect()} == set(range(12))
