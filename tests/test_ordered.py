"""Numbering and scanning a long order in intervals."""

import random

from pyspark.sql import functions as F

from tracewright.operators import ordered


def test_numbers_and_scans_equal_a_sorted_list(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(40)]), f"k{i}", rng.randint(-9, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "at long, name string, v int")
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    got = ordered.numbered(df, "at", [F.col("at").asc_nulls_last(), "name"], "n", 8)
    out = ordered.scans(got, "n", sums={"s": F.col("v")}, least={"m": F.col("v")}, intervals=8).orderBy("n").collect()
    assert [(r.at, r.name, r.n) for r in out] == [(a, k, i + 1) for i, (a, k, _) in enumerate(want)]
    total, low = 0, 99
    for r, (_, _, v) in zip(out, want, strict=True):
        total, low = total + v, min(low, v)
        assert (r.s, r.m) == (total, low)


def test_text_keys_and_empty_tables(spark):
    names = [f"/logs/{i * 7919 % 1000:03d}.jsonl" for i in range(300)]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = ordered.numbered(df, "path", ["path"], "n", 8, like=df.limit(50)).orderBy("n").collect()
    assert [r.path for r in got] == sorted(names) and [r.n for r in got] == list(range(1, 301))
    assert ordered.numbered(df.where("false"), "path", ["path"], "n").collect() == []
