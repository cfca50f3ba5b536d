import math
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tracewright.llm import quality_rules
from tracewright.llm.quality_rules import base_rules, judge, log_ratios, query, trusted_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def grams(text, buckets):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    one = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in WORD.findall((text or "").lower())]
    long_ = lambda v, seed: xxhash.xxh64(struct.pack("<q", v), seed=seed).intdigest()
    two = [signed(long_(b, long_(a, 42))) for a, b in zip(one, one[1:], strict=False)]
    return [h % buckets for h in one + two]


def brute(rows, trusted, buckets, threshold):
    t, r = (Counter(b for x in texts for b in grams(x, buckets)) for texts in (trusted, [x for _, x in rows]))
    nt, nr = sum(t.values()), sum(r.values())
    ratio = [round(math.log((t[b] + 1) / (nt + buckets)) - math.log((r[b] + 1) / (nr + buckets)), 6) if nt else 0.0 for b in range(buckets)]
    out = []
    for doc, text in rows:
        g, b = grams(text, buckets), base(text)
        score = sum(ratio[x] for x in g) / max(1, len(g))
        out.append((doc, *b, not b[-1] and round(score, 6) >= threshold, score))
    return sorted(out, key=repr)


def check(got, want):
    got = sorted((tuple(r) for r in got), key=repr)
    assert [r[:-1] for r in got] == [r[:-1] for r in want]
    assert [r[-1] for r in got] == pytest.approx([r[-1] for r in want], abs=2e-6)


def test_query_equals_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    out = query(spark, sf_dir)
    assert tuple(out.columns) == names
    check(out.collect(), brute(rows, [t for i, t in rows if i in good], quality_rules.BUCKETS, quality_rules.THRESHOLD))
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def test_odd_rows(docs, corpus, empty, spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, None), (2, 1, 1), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    clash = docs.withColumns({"n_words": F.lit("x"), "bucket": F.lit(1), "n": F.lit(2), "score": F.lit("y"), "row": F.lit(3), "grams": F.lit(4), "__grams": F.lit(5), "__lines": F.lit(6), "hashes": F.lit(7)})
    out = judge(clash, trusted_texts(clash, labels), 64)
    assert {(r.bucket, r.n, r.row, r.grams, r["__grams"], r["__lines"], r.hashes) for r in out.collect()} == {(1, 2, 3, 4, 5, 6, 7)}
    out = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    rows = [(r[0], r[1]) for r in corpus]
    trusted = [t for i, t in rows if i in (0, 1)]
    check(out.collect(), brute(rows, trusted, 64, quality_rules.THRESHOLD))
    assert {r.score for r in judge(docs, trusted_texts(docs, labels.limit(0)), 64).collect()} == {0.0}
    assert judge(empty, trusted_texts(empty, labels)).collect() == []
    assert len(log_ratios(docs, docs, 32).first().ratios) == 32


def test_long_repetitive_text(spark):
    text = "a b c d " * 20000 + "x\ny\nx\n" * 1000
    r = base_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text)


def test_windows_keep_their_case(spark):
    text = "One two three One Two three one two THREE " * 6 + "a b c A B C a b d"
    r = base_rules(spark.createDataFrame([(1, text), (2, "a b c A b c a B c")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(x.n_words, x.n_repeat_words) for x in r] == [(base(text)[0], base(text)[4]), (9, 0)]
