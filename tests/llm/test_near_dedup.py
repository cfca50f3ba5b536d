import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm.components import connected_components
from tracewright.llm import near_dedup
from tracewright.llm.near_dedup import near_groups, one_of_each, super_minhash
from tracewright.llm.textblocks import mix64

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute(rows, width=4):
    sets = [shingles(r[1], width) for r in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(parent, i)] = find(parent, j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(parent, j) == find(parent, i) and rows[j][0] is not None]
        head = min(ids) if ids else None
        if not sets[i]:
            head = r[0]
        out.append((r[0], len(sets[i]), head, r[0] == head))
    return sorted(out, key=repr)


def family(rng, size, edits):
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(100)]
    for _ in range(size):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        yield " ".join(t)


def test_equals_brute_force(spark, docs, corpus):
    got = near_groups(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == brute(corpus)


def test_chains_and_borderline_families(spark):
    rng = random.Random(3)
    texts = [t for size, edits in ((40, 4), (30, 8), (5, 2), (2, 1)) for t in family(rng, size, edits)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(30):  # each link is near, the ends are not
        chain = [*chain[4:], *(f"n{i}x{j}" for j in range(4))]
        texts.append(" ".join(chain))
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == brute(rows)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 5, 200, 3000):
        pool = mix64(rng.integers(0, 2**62, 2 * n).astype(np.uint64))
        a, b = pool[: n + n // 2], pool[n // 2 :]
        both = np.concatenate([a, b])
        sig = super_minhash(both, np.array([0, len(a), len(both)]), 1024)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.08
        assert (sig < np.uint64(1024) << np.uint64(32)).all()
        assert (super_minhash(a, np.array([0, len(a)]), 1024)[0] == sig[0]).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (3, 4), (4, 5), (20, 5), (11, 11), (2, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 20: 1, 10: 10, 11: 10} | {100 + i: 100 for i in range(41)}


def test_extra_columns_and_empty_table(docs, empty):
    clash = docs.withColumns({"cid": F.lit(1), "k0": F.lit("x"), "sig": F.lit(None).cast("int"), "kept": F.lit(2)})
    assert near_groups(clash).count() == docs.count()
    assert near_groups(empty).collect() == []


def test_rows_without_shingles_all_stay(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, None)] * 3 + [(None, "")] * 2 + [(5, "")] * 2 + [(6, " \n")] + [(1, text)] * 2 + [(2, text)]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), width=5).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows[:8] + [(1, text)], key=repr)


def exact_heads(rows, width):
    """Least id of each component by an exact prefix-filtered join, without signatures."""
    sets = {i: shingles(t, width) for i, t in rows}
    often = Counter(x for s in sets.values() for x in s)
    parent, index = {i: i for i in sets}, defaultdict(list)
    for i in sorted(sets, key=lambda i: (len(sets[i]), i)):
        own = sorted(sets[i], key=lambda x: (often[x], x))
        prefix = own[: len(own) - -(-4 * len(own) // 5) + 1]
        for j in {j for x in prefix for j in index[x]}:
            if find(parent, i) != find(parent, j) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(parent, i), find(parent, j)))
                parent[b] = a
        for x in prefix:
            index[x].append(i)
    return {i: find(parent, i) for i in sets}


def test_equals_an_exact_join(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = exact_heads([(r.doc_id, r.text) for r in docs.collect()], 4)
    got = {r.doc_id: r.component_id for r in near_groups(docs).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_divided_buckets_equal_brute_force(spark, monkeypatch):
    """Hot buckets are divided by further bands, and nothing is lost."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"u{i}x{j}" for j in range(20)]) for i in range(60)]
    texts += [t + f" tail{i}" for i, t in enumerate(texts[:12])]
    texts += list(family(rng, 20, 6))
    rows = list(enumerate(texts))
    divided = []
    written = near_dedup.materialize
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "FAN", 1)
    monkeypatch.setattr(near_dedup, "materialize", lambda df, name: (divided.append(name), written(df, name))[1])
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert "divided" in divided
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == brute(rows)


def test_large_mixed_bucket_is_linear(spark, monkeypatch):
    """Many unlinked texts around one passage: no table has more rows than a fixed number for each class of a bucket."""
    passage = " ".join(f"p{i}" for i in range(60))
    sizes = {}
    written = near_dedup.materialize

    def counted(df, name):
        table = written(df, name)
        sizes[name] = max(sizes.get(name, 0), table.count())
        return table

    monkeypatch.setattr(near_dedup, "materialize", counted)
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "FAN", 3)
    for n in (300, 1200):
        sizes.clear()
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(passage + " "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda j: F.concat(F.lit("u"), F.col("id"), F.lit("x"), j)), " ")).alias("text"))
        assert near_groups(docs).where("kept").count() == n
        assert sizes["divided"] <= sizes["members"] * near_dedup.SUB_BANDS
        assert sizes["texts"] <= n and sizes["last-links"] == 0


def test_repeated_rows_are_one_class(spark, monkeypatch):
    a = " ".join(f"w{i}" for i in range(100))
    docs = spark.range(20_000).select((F.col("id") % 2).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit(a)).otherwise(F.lit(a + " more")).alias("text"))
    sizes = {}
    written = near_dedup.materialize

    def counted(df, name):
        table = written(df, name)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(near_dedup, "materialize", counted)
    out = near_groups(docs)
    assert (out.count(), out.where("component_id = 0").count(), out.where("kept").count()) == (20_000, 20_000, 10_000)
    assert sizes["texts"] == 2 and sizes["links"] == 1


def test_very_long_text(spark):
    rng = random.Random(1)
    long_ = " ".join(f"w{rng.randrange(50_000)}" for _ in range(300_000))
    rows = [(1, long_), (2, long_ + " end"), (3, "x " + long_[: len(long_) // 2]), (4, "short text of six words only")]
    assert {r.doc_id: r.component_id for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_clashing_names_pass_through(docs, corpus):
    clash = docs.withColumns({x: F.lit(i) for i, x in enumerate(("k0", "k1", "row", "one", "grouped", "__k0", "group"))})
    out = one_of_each(clash, width=5)
    assert out.columns == clash.columns and {(r.k0, r.row, r["__k0"]) for r in out.collect()} == {(0, 2, 5)}
    assert out.count() == one_of_each(docs, width=5).count()
