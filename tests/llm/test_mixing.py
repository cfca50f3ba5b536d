from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright.llm import mixing
from tracewright.llm.mixing import mix, mixed_rows, source_targets


def water_fill(sizes, weights, epochs):
    """Clamp and redistribute until no source is above its cap."""
    budget, open_, out = float(sum(sizes)), set(range(len(sizes))), {}
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if budget * weights[i] / w > epochs * sizes[i]}
        if not over:
            return [out[i] if i in out else budget * weights[i] / w for i in range(len(sizes))]
        for i in over:
            out[i] = float(epochs * sizes[i])
        budget -= sum(out[i] for i in over)
        open_ -= over
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[100, 10, 5, 1, 0, 40], [1, 1, 1], [0, 0], [10**9, 1, 2, 3, 4, 5, 6], [7]])
def test_targets(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()}
    want = water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3)
    assert [got[n] for n in names] == pytest.approx(want)


def test_equals_sql_and_targets_are_met(spark, sf_dir):
    duckdb.sql(f"create or replace view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(duckdb.sql(mixing.ORACLE).fetchall())
    got = sorted(tuple(r) for r in mixing.query(spark, sf_dir).collect())
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    source = dict(duckdb.sql("select doc_id, source from documents").fetchall())
    taken_of, target_of = defaultdict(int), {}
    for doc, size, _, target, taken in got:
        assert 0 <= taken <= 3 * size
        taken_of[source[doc]] += taken
        target_of[source[doc]] = target
    assert all(abs(taken_of[s] - t) <= 1 for s, t in target_of.items())


def test_odd_rows(docs, empty):
    clash = docs.withColumns({"size": F.lit("x"), "copies": F.lit(1), "before": F.lit(2), "left": F.lit(3)})
    out = mix(clash, buckets=4).collect()
    assert len(out) == docs.count() and {r["left"] for r in out} == {3}
    groups = defaultdict(lambda: [0, 0.0])
    for r in out:
        groups[r.source][0] += r["size"] * r.copies + r.extra
        groups[r.source][1] = r.target
    assert None in groups and all(abs(a - b) <= 1 for a, b in groups.values())
    assert mix(empty).collect() == []
    again = sorted(map(repr, mix(docs.repartition(7), buckets=4).collect()))
    assert again == sorted(map(repr, mix(docs, buckets=4).collect()))


def test_rows_of_the_mix(docs):
    taken = {}
    for r in mix(docs, buckets=4).collect():
        key = (r.source, r.target)
        taken[key] = taken.get(key, 0) + r["size"] * r.copies + r.extra
    rows = mixed_rows(docs, buckets=4)
    assert rows.columns == docs.columns
    got = defaultdict(int)
    for r in rows.collect():
        got[r.source] += len((r.text or "").split())
    assert {k[0]: v for k, v in taken.items() if v} == {k: v for k, v in got.items() if v}


def test_clashing_names_and_very_long_texts(docs, spark):
    clash = docs.withColumns({x: F.lit(i) for i, x in enumerate(("doc", "extra", "size", "nth", "cut", "__extra", "__doc", "row"))})
    out = mixed_rows(clash, buckets=4)
    assert out.columns == clash.columns and {(r.doc, r.extra, r["size"], r.nth, r["__doc"]) for r in out.collect()} == {(0, 1, 2, 3, 6)}
    rows = [(1, "word " * 400_000, "a"), (2, "one two", "b"), (3, None, "c")]
    got = {r.doc_id: r["size"] for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: 400_000, 2: 2, 3: 0}
