from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import quality
from tracewright.llm.linear import _tables, platt
from tracewright.llm.quality import classify, query, shapes, site_posteriors, train, with_evidence


def test_shapes():
    out = shapes(pa.array(["", None, "a a a B", "AB #$ cd"]))
    assert not out[:2].any()
    assert out[2] == pytest.approx([2 / 2, 0.5, 0.5, 1 / 7, 0, 1, np.log(5)])
    assert out[3] == pytest.approx([3 / 3**0.5, 1, 0, 2 / 8, 2 / 8, 2, np.log(4)])


def test_posteriors_shrink_toward_the_level_above(spark):
    rng = np.random.default_rng(0)
    rows = []
    for h in range(40):
        rate = rng.beta(2, 2)
        for p in range(3):
            for _ in range(2 if h == 0 else 200):
                rows.append((True, f"h{h}", True, f"p{p}", float(rng.normal(2 if rng.random() < rate else -2, 0.3))))
    scored = spark.createDataFrame(rows, "h0 boolean, h1 string, p0 boolean, p1 string, odds double")
    sites, mean = site_posteriors(scored)
    raw = {}
    for _, h, _, p, o in rows:
        raw.setdefault((h, p), []).append(1 / (1 + np.exp(-o)))
    assert mean == pytest.approx(np.mean([x for v in raw.values() for x in v]))
    for r in sites.collect():
        own = np.mean(raw[r.h1, r.p1])
        assert min(own, r.host) - 1e-9 <= r.site <= max(own, r.host) + 1e-9
        pooled = np.mean([x for p in range(3) for x in raw[r.h1, f"p{p}"]])
        assert min(pooled, mean) - 1e-9 <= r.host <= max(pooled, mean) + 1e-9
        if r.h1 != "h0":
            assert abs(r.host - pooled) < 0.02


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = labels.where("doc_id % 3 = 0")
    out = classify(docs, labels.where("doc_id % 3 <> 0")).join(held, "doc_id").select("kept", "quality").collect()
    good = [r.kept for r in out if r.quality == 1]
    bad = [r.kept for r in out if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_odd_rows(docs, corpus, empty, spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    clash = docs.withColumns({x: F.lit(i) for i, x in enumerate(("site", "host", "evidence", "n", "row", "odds", "_", "h0", "p1", "__odds", "__text", "__h0", "__site"))})
    out = classify(clash, labels)
    assert set(clash.columns) <= set(out.columns) and out.count() == len(corpus)
    assert {(r.site, r.row, r["_"], r["__odds"]) for r in out.collect()} == {(0, 4, 6, 9)}
    equal = {}
    for r in out.collect():
        assert equal.setdefault((r.doc_id, r.text, r.source, r.lang), r.quality_score) == r.quality_score
    assert classify(empty, labels).collect() == []
    assert all(r.kept for r in classify(docs, labels.limit(0)).collect())
    assert all(r.kept for r in classify(docs, labels.where("quality = 1")).collect())
    assert query(spark, "/root/testdata/sf0.001").count() == 200
    assert with_evidence(docs, train(docs, labels), "source", "lang", ["doc_id"]).columns == ["row", *quality.SITE, "odds"]
    assert classify(docs, labels, carry=["lang"]).columns == ["lang", *quality.RESULTS]


def plain_trigrams(text, bits=13):
    """Frequencies of hashed byte trigrams, one at a time."""
    tables = _tables(bits)
    raw = b" " + (text or "").encode() + b" "
    counts = Counter(int(tables[0][raw[i]] ^ tables[1][raw[i + 1]] ^ tables[2][raw[i + 2]]) for i in range(len(raw) - 2))
    return {k: v / (len(raw) - 2) for k, v in counts.items()} if text else {}


def brute(docs, labels, threshold):
    """The method in primal form with dense matrices, dictionaries and no Spark."""
    x = np.zeros((len(docs), 1 << 13))
    for i, d in enumerate(docs):
        for k, v in plain_trigrams(d["text"]).items():
            x[i, k] = v
    z = shapes(pa.array([d["text"] for d in docs], pa.string()))
    some = np.array([bool(d["text"]) for d in docs])
    learn = [i for i, d in enumerate(docs) if d["doc_id"] in labels and d["text"] is not None]
    y = np.array([1.0 if labels[docs[i]["doc_id"]] else -1.0 for i in learn])
    w = np.where(y > 0, 1 / (y > 0).sum(), 1 / (y < 0).sum())
    w /= w.mean()
    scale = 1 / np.sqrt(x[learn].mean(axis=0) + 1e-5)
    full = np.hstack([x * scale, (z - z[learn].mean(axis=0)) / (z[learn].std(axis=0) + 1e-9)])
    n, root = len(learn), np.sqrt(w)[:, None]
    mean, my = w @ full[learn] / n, w @ y / n
    a, b = (full[learn] - mean) * root, ((y - my) * root[:, 0])
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    coef = vt.T @ (s / (s * s + quality.PENALTY) * (u.T @ b))
    hat = (u * (s * s / (s * s + quality.PENALTY))) @ u.T
    left_out = (b - (b - hat @ b) / (1 - np.diag(hat))) / root[:, 0] + my
    slope, intercept = platt(left_out, y > 0)
    odds = np.clip(slope * ((full - mean) @ coef + my) + intercept, -12, 12)
    odds = np.where(some, odds, np.log((y > 0).sum() / (y < 0).sum()))
    p = 1 / (1 + np.exp(-odds))

    def shrink(groups, above):
        """Posterior means of groups of rows toward the mean above each."""
        m = {g: p[r].mean() for g, r in groups.items()}
        size = {g: len(r) for g, r in groups.items()}
        rows = sum(size.values())
        strength = 1e4
        if len(groups) > 1 and rows > len(groups):
            inside = sum(((p[r] - m[g]) ** 2).sum() for g, r in groups.items()) / (rows - len(groups))
            free = rows - sum(v * v for v in size.values()) / rows
            variance = (sum(size[g] * (m[g] - above[g]) ** 2 for g in groups) - (len(groups) - 1) * inside) / free
            spread = np.mean([above[g] * (1 - above[g]) for g in groups])
            strength = np.clip(spread / variance - 1, 1.0, 1e4) if variance > 0 else 1e4
        return {g: (strength * above[g] + size[g] * m[g]) / (strength + size[g]) for g in groups}

    hosts, paths = {}, {}
    for i, d in enumerate(docs):
        hosts.setdefault(d["source"], []).append(i)
        paths.setdefault((d["source"], d["lang"]), []).append(i)
    mean_p = p.mean()
    host = shrink(hosts, dict.fromkeys(hosts, mean_p))
    path = shrink(paths, {g: host[g[0]] for g in paths})
    logit = lambda v: np.log(v / (1 - v))
    out = []
    for i, d in enumerate(docs):
        score = 1 / (1 + np.exp(-(odds[i] + logit(path[d["source"], d["lang"]]) - logit(mean_p))))
        out.append((d["doc_id"], score >= threshold, odds[i], host[d["source"]], path[d["source"], d["lang"]], score))
    return sorted(out)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality > 0 for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    want = brute(docs, labels, quality.THRESHOLD)
    got = sorted(tuple(r) for r in query(spark, sf_dir).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.array([r[2:] for r in got]) == pytest.approx(np.array([r[2:] for r in want]), abs=2e-2)


def test_repeated_ids_and_labels_make_one_model(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    twice = docs.unionByName(docs).repartition(5)
    a, b = (train(d, x).model for d, x in ((docs, labels), (twice, labels.unionByName(labels))))
    assert np.allclose(a.weights, b.weights, atol=1e-4)


def test_very_long_text(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    rows = [(i, "good words here and there. " * 9 if i % 2 else "$$ #spam# $$ " * 9, "s", "en") for i in range(20)]
    rows += [(100, "good words here and there. " * 90_000, "s", "en")]
    got = {r.doc_id: r.kept for r in classify(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), labels).collect()}
    assert got == {i: i % 2 == 1 for i in range(20)} | {100: True}
