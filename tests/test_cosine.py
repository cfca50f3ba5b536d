"""Cosines of all pairs, block by block, against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracewright.operators import cosine
from tracewright.plans import corpus


def brute(docs, least):
    counts = {d: Counter(re.findall(corpus.WORD, t.lower())) for d, t in docs if t is not None}
    n, df = len(counts), Counter(w for c in counts.values() for w in c)
    vectors = {}
    for d, c in counts.items():
        v = {w: k * (math.log((1 + n) / (1 + df[w])) + 1) for w, k in c.items()}
        norm = math.sqrt(math.fsum(x * x for x in v.values()))
        vectors[d] = {w: x / norm for w, x in v.items()}
    vectors, least_of = {d: v for d, v in vectors.items() if v}, {}
    rep = {d: least_of.setdefault(tuple(sorted((w, round(x, 9)) for w, x in v.items())), d) for d, v in sorted(vectors.items())}
    reps = sorted(set(rep.values()))
    dot = lambda a, b: math.fsum(x * vectors[b].get(w, 0) for w, x in vectors[a].items())
    return {(a, b): s for i, a in enumerate(reps) for b in reps[i + 1 :] if (s := dot(a, b)) > least}, rep


def texts(n):
    r = random.Random(5)
    words = [["".join(r.choices("abcdefgh", k=5)) for _ in range(400)] for _ in range(2)]
    docs = [(d, " ".join(["The" if d % 2 else "der"] * 3 + r.choices(words[d % 2], weights=[1 / (i + 1) for i in range(400)], k=r.randint(3, 60)))) for d in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, docs[3][1]), (n + 3, docs[7][1] + " " + docs[7][1]), (n + 4, "x 1 !")]


@pytest.mark.parametrize("most", [1, 16, 1536])
def test_blocks_of_any_size_give_all_pairs(spark, most):
    docs = texts(90)
    pairs, rep = brute(docs, 0.4)
    whole, classes = cosine.blocks(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), corpus.WORD, most)
    assert whole.count() >= 90 / most and {r.doc_id: r.rep for r in classes.collect()} == rep
    got = {(r.a, r.b): r.cosine for r in cosine.compared(whole, 0.4).collect()}
    assert got.keys() == pairs.keys() and all(abs(got[k] - v) < 1e-9 for k, v in pairs.items())
    links = Counter(x for pair in pairs for x in pair)
    assert {r.rep: r.links for r in cosine.compared(whole, 0.4, links=True).collect()} == links


def test_string_ids_and_texts_of_one_id(spark):
    docs = [("b", "red green blue"), ("a", "green blue"), ("a", "red"), ("c", "red green"), ("d", None)]
    rows = spark.createDataFrame(docs, "doc_id string, text string")
    assert {(r.doc_id, r.rep, r.links) for r in corpus.similarity_links(rows).collect()} == {("a", "a", 1), ("b", "a", 1), ("c", "c", 1)}
    assert [(r.a, r.b) for r in corpus.similar_documents(rows).collect()] == [("a", "c")]
    assert corpus.similar_documents(rows.where("doc_id = 'd'")).count() == 0


def shuffled(spark, run):
    """Rows that the stages of ``run`` write for others to read."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("query", [corpus.similar_documents, corpus.similarity_links])
def test_pairs_are_not_shuffled(spark, query):
    """Tables of candidate pairs and of their terms filled the disk."""
    some = texts(90)
    docs = spark.createDataFrame([(d, f"{some[d % 90][1]} own{chr(97 + d // 90)}") for d in range(450)], "doc_id bigint, text string")
    assert corpus.similar_documents(docs).count() > 10_000
    assert shuffled(spark, lambda: query(docs).foreach(lambda _: None)) < 5_000


def test_blocks_hold_documents_of_one_vocabulary():
    """Blocks of mixed languages left most terms dense; the most frequent word does not tell languages apart."""
    r = random.Random(3)
    words = [[f"{w}{a}{b}" for a in "abcdef" for b in "abcdef"] for w in ("x", "y")]
    docs = [(d, " ".join(["same"] * (9 if d % 3 else 0) + r.choices(words[d % 2], k=40))) for d in range(128)]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
    blocks = [b["ids"][0].as_py() for b in cosine._packed(iter([batch]), corpus.WORD, pa.int64(), 16)]
    assert sorted(d for b in blocks for d in b) == list(range(128))
    assert sum(len({d % 2 for d in b}) > 1 for b in blocks) <= 1


def test_links_in_single_precision_are_exact(spark, monkeypatch):
    """Links were counted in double precision throughout; what single precision leaves open is summed again."""
    whole = cosine.blocks(spark.createDataFrame(texts(90), "doc_id bigint, text string"), corpus.WORD)[0].toArrow()
    x, y = (kind(lambda k: whole[k][0]) for kind in (cosine.Documents, cosine.Terms))
    kinds, rows = set(), cosine.Product.rows
    monkeypatch.setattr(cosine.Product, "rows", lambda self, a, b, kind: kinds.add(kind) or rows(self, a, b, kind))
    exact = cosine.Product(x, y).rows(0, x.n, float)[np.triu_indices(x.n, 1)]
    kinds.clear()
    for c in np.sort(exact[exact > 0.1])[::40]:
        for least in (c - 1e-12, c + 1e-12):
            of_x, of_y = cosine._links(x, y, least, True)
            assert of_x.sum() == of_y.sum() == np.count_nonzero(exact > least)
    assert kinds == {np.float32}
