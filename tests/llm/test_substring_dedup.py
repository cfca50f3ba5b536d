import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tracewright.llm import substring_dedup
from tracewright.llm.substring_dedup import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    seen = Counter()
    split = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    for _, w in split:
        seen.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for doc, w in split:
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def test_equals_brute_force(docs, corpus):
    for k, m in ((35, 8), (10, 3)):
        got = dedup_substrings(docs, k, m).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute(corpus, k)


def test_spans_cover_what_was_removed(docs):
    for r in dedup_substrings(docs).collect():
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert r.n_words - r.n_removed == len(WORD.findall(r.kept))


def test_extra_columns_and_empty_table(docs, empty):
    clash = docs.withColumns({"k0": F.lit(1), "anchor": F.lit("x"), "spans": F.lit(None).cast("int"), "p1": F.lit(2)})
    assert dedup_substrings(clash).count() == docs.count()
    assert dedup_substrings(empty).collect() == []


def test_hot_phrase_stays_linear(spark, monkeypatch):
    """One phrase in many texts: tables grow with the texts, not with their square."""
    sizes = {}
    written = substring_dedup.materialize

    def counted(df, name):
        table = written(df, name)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(substring_dedup, "materialize", counted)
    phrase = " ".join(f"p{i}" for i in range(30))
    seen = []
    for n in (50, 200):
        rows = [(i, " ".join(f"u{i}x{j}" for j in range(30)) + f" {phrase} " + " ".join(f"v{i}x{j}" for j in range(30))) for i in range(n)]
        rows += [(n + i, f"both {phrase} end of it and more " + " ".join(f"z{j}" for j in range(9))) for i in range(n // 10)]
        got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute(rows, 35)
        seen.append(dict(sizes))
    assert all(seen[1][name] <= 5 * max(seen[0][name], 10) for name in seen[0])


def test_compaction_stops_at_branches(spark):
    """Two texts share a long passage; a third leaves it half way."""
    w = [f"w{i}" for i in range(90)]
    rows = [(1, " ".join(w)), (2, "x " + " ".join(w)), (3, " ".join(w[:50] + [f"y{i}" for i in range(50)]))]
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 10, 3).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute(rows, 10)


def test_spans_with_other_words_are_not_removed(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(20))), (2, " ".join(f"a{i}" for i in range(10)) + " " + " ".join(f"b{i}" for i in range(10)))]
    keyed = spark.createDataFrame(rows, "doc_id long, text string").select(*substring_dedup.text_key(), "text")
    key = {r.k0: r.k1 for r in keyed.collect()}
    claims = [(1, key[1], 0, 3, 2, key[2], 0), (1, key[1], 8, 3, 2, key[2], 8)]  # the second is what a collision of hashes would give
    spans = spark.createDataFrame(claims, "k0 long, k1 long, start int, edges int, o0 long, o1 long, o_start int")
    assert [r.start for r in substring_dedup.verified(spans, keyed, 5).collect()] == [0]


def test_repeated_rows_and_very_long_texts(spark):
    rng = random.Random(2)
    long_ = " ".join(f"w{rng.randrange(20_000)}" for _ in range(200_000))
    rows = [(1, "one text that is repeated as it is " * 9)] * 30 + [(2, long_), (3, "start " + long_[: len(long_) // 3])]
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute(rows, 35)
