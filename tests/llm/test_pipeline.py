import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_mixing import water_fill
from tests.llm.test_near_dedup import brute as brute_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_schema(stages):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for s in stages[1:-1]:
        assert s.dtypes == stages[0].dtypes
        assert s.where("n_chars <> length(text)").count() == 0


def test_quality_keeps_good_documents(spark, sf_dir, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in rows(stages[1])}
    good, bad = ([i in kept for i, q in labels.items() if q == v] for v in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.3 * len(bad)
    texts = {r["doc_id"]: r["text"] for r in rows(stages[0])}
    assert all(texts[r["doc_id"]] == r["text"] for r in rows(stages[1]))


def test_lines(stages):
    want = brute_lines([(r["doc_id"], r["text"]) for r in rows(stages[1])])
    assert sorted((r["doc_id"], r["text"]) for r in rows(stages[2])) == sorted((r[0], r[1]) for r in want)


def test_groups(stages):
    before = rows(stages[2])
    heads = {r[0] for r in brute_groups([(r["doc_id"], r["text"]) for r in before], 5) if r[3]}
    assert sorted(map(repr, rows(stages[3]))) == sorted(repr(r) for r in before if r["doc_id"] in heads)


def test_mix(stages):
    before, after = rows(stages[3]), rows(stages[4])
    n = lambda t: len(WORD.findall(t or ""))
    size, taken, times = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        size[r["source"]] += n(r["text"])
    whole = {r["doc_id"]: n(r["text"]) for r in before}
    for r in after:
        taken[r["source"]] += n(r["text"])
        times[r["doc_id"]] += n(r["text"])
    names = sorted(size)
    target = water_fill([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    assert all(abs(taken[s] - t) <= 1 for s, t in zip(names, target, strict=True))
    assert all(v <= 3 * whole[i] for i, v in times.items())


def test_encoding(stages):
    import sentencepiece

    from tracewright.llm.piece_codec import default_model

    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = []
    for r in rows(stages[4]):
        ids = library.encode(r["text"])
        want.append((r["doc_id"], len(ids), ids, hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], list(r["ids"]), r["decoded_sha256"]) for r in rows(stages[5])]
    assert sorted(got) == sorted(want)


def test_run_equals_stages(spark, sf_dir, stages):
    total = lambda df: df.agg(F.count("*"), F.sum("n_tokens"), F.bit_xor(F.xxhash64("doc_id", "ids"))).first()
    assert total(corpus_pipeline.run(spark, sf_dir)) == total(stages[5])


def test_odd_rows(spark, docs, empty, tmp_path):
    spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, empty):
        out = table
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, str(tmp_path))
        out.collect()
