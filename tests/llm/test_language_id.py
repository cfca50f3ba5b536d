import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm.language_id import AMBIGUOUS, PER_LANGUAGE, SAMPLE, code_matrix, identify, query, train, training_rows
from tracewright.llm.linear import _tables, fit_ridge, frequencies, row_sums, trigrams


def test_codes_keep_their_distance():
    for n in (2, 3, 4, 5, 8, 40):
        code = code_matrix(n).astype(int)
        near = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert set(code.ravel()) <= {-1, 1} and near >= (1 if n == 2 else code.shape[1] // 4)
        assert (np.abs(code.sum(axis=0)) < n).all()


def test_row_sums_and_trigrams():
    texts = pa.array(["", "a", "Ab", None, "héllo wörld", ""])
    index, offsets = trigrams(texts, lower=True)
    assert np.diff(offsets).tolist() == [0, 1, 2, 0, 13, 0]
    assert index[0] != index[1] and trigrams(pa.array(["ab"]), lower=True)[0].tolist() == index[1:3].tolist()
    w = np.random.default_rng(0).normal(size=(1 << 13, 3)).astype(np.float32)
    want = np.array([w[index[a:b]].sum(axis=0) if b > a else np.zeros(3) for a, b in zip(offsets, offsets[1:], strict=False)])
    assert np.allclose(row_sums(w, index, offsets), want, atol=1e-5)


def test_left_out_scores_are_those_of_refits():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc" if i % 2 else "bcd"), 30)) for i in range(12)]
    sparse = frequencies(*trigrams(pa.array(texts)))
    y = np.array([[1.0] if i % 2 else [-1.0] for i in range(12)])
    fit = fit_ridge(sparse, np.zeros((12, 0)), y, np.ones(12), 3.0)
    index, offsets = trigrams(pa.array(texts))
    assert np.sign(fit.scores(index, offsets)).tolist() == y.tolist()
    assert (np.abs(fit.left_out - y) >= np.abs(fit.scores(index, offsets) - y) - 1e-6).all()


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = query(spark, sf_dir).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.95
    assert np.mean([r.ambiguous for r in rows]) < 0.2


def test_many_languages(spark):
    rng = np.random.default_rng(4)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows, i = [], 0
    for lang in range(9):
        letters = list(rng.choice(list(alphabet), 9, replace=False))
        for _ in range(40):
            rows.append((i, " ".join("".join(rng.choice(letters, 5)) for _ in range(20)), f"l{lang}"))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(docs, train(docs)).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out]) > 0.95


def test_odd_rows(docs, corpus, empty, spark):
    clash = docs.withColumns({"keys": F.lit(1), "place": F.lit("x"), "held_out": F.lit(3)})
    rows = identify(clash, train(clash)).collect()
    assert len(rows) == len(corpus)
    assert {r.lang_pred for r in rows} == {"en", "und"}
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert identify(empty, train(empty)).collect() == []
    blank = spark.createDataFrame([(1, "123 !!", "en"), (2, None, "en"), (3, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in identify(blank, train(blank)).orderBy("doc_id").collect()][:2] == [("und", 0.0)] * 2


def plain_decode(codes, text):
    """Language, score and ambiguity of one text, a trigram, a bit and a language at a time."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, False
    tables = _tables(13)
    raw = b" " + bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()) + b" "
    score = codes.model.bias.astype(float).copy()
    for i in range(len(raw) - 2):
        score += codes.model.weights[tables[0][raw[i]] ^ tables[1][raw[i + 1]] ^ tables[2][raw[i + 2]]] / (len(raw) - 2)
    loss = [sum(w * max(0.0, 1 - s * bit) for w, s, bit in zip(codes.bit_weight, score, word, strict=True)) for word in codes.code]
    near = [math.exp(-4 * (x - min(loss))) for x in loss]
    first, second = sorted(loss)[:2]
    return codes.languages[loss.index(first)], 1 / sum(near), second - first < AMBIGUOUS


def test_query_equals_brute_force(spark, sf_dir):
    """The learned rows and the decoder, without Spark and numpy's block operations."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = [r for r in docs.collect() if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    each = min(PER_LANGUAGE, SAMPLE // len({r.lang for r in table}))
    ranked = sorted((r.lang, hashlib.md5(f"lang:{r.doc_id}".encode()).hexdigest(), r.doc_id, r.text) for r in table)
    want = sorted((x[0], x[3]) for lang in {r.lang for r in table} for x in [y for y in ranked if y[0] == lang][:each])
    assert sorted(map(tuple, training_rows(docs, SAMPLE, PER_LANGUAGE).collect())) == want
    codes = train(docs)
    got = {r.doc_id: r for r in query(spark, sf_dir).collect()}
    for r in docs.collect():
        lang, score, close = plain_decode(codes, r.text)
        own = got[r.doc_id]
        assert own.score == pytest.approx(score, abs=2e-3)
        if score > 0.505:
            assert (own.lang_pred, own.ambiguous) == (lang, close) or abs(score - 0.5) < 0.02


def test_fit_is_that_of_the_primal_form():
    """Ridge weights and left-out scores against refits with dense matrices."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcd" if i % 3 else "cdef"), 40)) for i in range(15)]
    sparse = frequencies(*trigrams(pa.array(texts)))
    x = np.zeros((15, 1 << 13))
    for i, (k, v) in enumerate(sparse):
        x[i, k] = v
    y = np.where(np.arange(15)[:, None] % 3, 1.0, -1.0)
    w = rng.random(15) + 0.5
    w /= w.mean()
    scaled = x / np.sqrt(x.mean(axis=0) + 1e-5)
    mean, my = w @ scaled / 15, w @ y / 15
    a, b = (scaled - mean) * np.sqrt(w)[:, None], (y - my) * np.sqrt(w)[:, None]
    coef = a.T @ np.linalg.solve(a @ a.T + 3 * np.eye(15), b)
    fit = fit_ridge(sparse, np.zeros((15, 0)), y, w, 3.0)
    index, offsets = trigrams(pa.array(texts))
    assert fit.scores(index, offsets) == pytest.approx((scaled - mean) @ coef + my, abs=1e-4)
    for i in range(15):
        rest = np.arange(15) != i
        own = a[rest].T @ np.linalg.solve(a[rest] @ a[rest].T + 3 * np.eye(14), b[rest])
        assert fit.left_out[i] == pytest.approx((scaled[i] - mean) @ own + my, abs=1e-4)


def test_every_language_is_learned(spark):
    """More languages than rows a language: each has a row, and any can be predicted."""
    rng = np.random.default_rng(8)
    langs = [f"l{i:03d}" for i in range(450)]
    rows = [(i * 5, " ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(8)) + f" {x} {x} {x}", x) for i, x in enumerate(langs)]
    rows += [(r[0] + 1, *r[1:]) for r in rows] + [(r[0] + 2, *r[1:]) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert train(docs).languages == langs
    got = identify(docs, train(docs)).collect()
    assert len({r.lang_pred for r in got}) > 400


def test_very_long_text(spark):
    rows = [(i, "the and of words " * 5 if i % 2 else "der die das und " * 5, "en" if i % 2 else "de") for i in range(40)] + [(99, "der die das und " * 100_000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in identify(docs, train(docs)).collect()}[99] == "de"
