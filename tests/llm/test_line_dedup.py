import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright.llm import line_dedup
from tracewright.llm.line_dedup import dedup_lines

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def lined(spark):
    t = "a 1\nb\nc\nd\ne"
    rows = [(5, t), (2, "x\na 1\n\nb\nc\nd"), (7, "c\nd\ne\nc\nd\ne\nz"), (None, t), (8, None), (9, ""), (10, "\n \n"), (11, "l\nl\nl\nl"), (12, "one\ntwo"), (2, "same id\nb\nc\nd"), (13, "b\nc"), (13, "b\nc"), (14, "p\nq\nr"), (14, "p\nq\nr")]
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)


def brute(rows):
    """Windows in order of (id, text) with equal rows as one document."""
    key = lambda r: (r[0] is None, r[0] or 0)
    first, out = {}, {}
    docs = sorted({(r[0], r[1]) for r in rows}, key=key)
    assert all(a[0] != b[0] or a[0] == 2 for a, b in zip(docs, docs[1:], strict=False))
    for doc in docs:
        lines = (doc[1] or "").split("\n") if doc[1] is not None else []
        worded = [i for i, x in enumerate(lines) if x.strip()]
        gone = set()
        for i in range(len(worded) - 2):
            w = tuple(lines[j] for j in worded[i : i + 3])
            if first.setdefault(w, (doc, i)) != (doc, i):
                gone |= set(worded[i : i + 3])
        out[doc] = (None if doc[1] is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(worded), len(gone))
    return sorted(((r[0], *out[r[0], r[1]]) for r in rows), key=repr)


def test_small_cases(lined):
    rows = [(r.doc_id, r.text) for r in lined.collect() if (r.doc_id, r.text) != (2, "same id\nb\nc\nd")]
    table = lined.where("not (doc_id <=> 2 and text like 'same%')")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_lines_removed) for r in dedup_lines(table).collect()), key=repr)
    assert got == brute(rows)
    assert dedup_lines(lined).count() == 14


def test_columns(lined, empty):
    clash = lined.withColumns({"at": F.lit(1), "h1": F.lit("x"), "lines": F.lit(2), "n_lines": F.lit("gone"), "first": F.lit(1), "row": F.lit(3), "__lines": F.lit(4), "__worded": F.lit(5), "__gone": F.lit(6), "__k0": F.lit(7), "__later": F.lit(8)})
    out = dedup_lines(clash)
    assert set(clash.columns) <= set(out.columns) and out.schema["n_lines"].dataType.simpleString() == "bigint"
    assert {(r.row, r["__lines"], r["__worded"], r["__gone"], r["__k0"], r["__later"]) for r in out.collect()} == {(3, 4, 5, 6, 7, 8)}
    assert out.count() == 14 and dedup_lines(empty).collect() == []


def test_equals_sql(spark, sf_dir):
    duckdb.sql(f"create or replace view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(duckdb.sql(line_dedup.ORACLE).fetchall())
    assert sorted(tuple(r) for r in line_dedup.query(spark, sf_dir).collect()) == want
    assert sum(r[2] for r in want) > 0


def test_very_long_text(spark):
    long_ = "\n".join(f"line {i}" for i in range(60_000))
    rows = [(1, long_, "en", "s", 1), (2, "x\nline 5\nline 6\nline 7\ny", "en", "s", 1)]
    got = {r.doc_id: (r.text, r.n_lines_removed) for r in dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (long_, 0), 2: ("x\ny", 3)}
