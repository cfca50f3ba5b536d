"""Line deduplication over overlapping windows of three lines.

Lines are what lies between ``\\n``; lines without a word stay where they are and
take no part.  Three consecutive lines with a word make a window.  Windows are
hashed and counted globally; of a repeated window the first occurrence, by
document id (null last), text hash and place, stays.  A line goes if a later
occurrence covers it; windows are judged on the input, so the covered places of
one document are simply merged.

A very common window is a skewed join key, which adaptive execution splits; what
is gathered for one document is at most one number a line.

Nulls: a null text stays null and has no lines.  Rows with the same id and the
same text count as one document in the order of occurrences, so they keep or
lose the same lines.  An empty text stays empty; further columns pass through,
whatever their names, but those named like a result are replaced by it.  A very
long text is one row's array of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
ADDED = ("n_lines", "n_lines_removed", "removed_lines")
HAS_WORD = r"[^\x20\x09-\x0D]"


def _order_key() -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("__k0"), F.xxhash64("text", "doc_id").alias("__k1")]


def windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``__k0, __k1, at, h1, h2``: windows by the place of their first line among the lines with a word."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(HAS_WORD))
    rows = docs.select(*_order_key(), lines.alias("lines")).where(F.size("lines") >= width)
    part = lambda i, j: F.element_at("lines", (i + j + 1).cast("int"))
    each = F.transform(
        F.sequence(F.lit(0), F.size("lines") - width),
        lambda i: F.struct(
            i.alias("at"),
            F.xxhash64(*(part(i, j) for j in range(width))).alias("h1"),
            F.xxhash64(F.lit("again"), *(part(i, j) for j in reversed(range(width)))).alias("h2"),
        ),
    )
    return rows.select("__k0", "__k1", F.inline(each))


def later_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``__k0, __k1, later``: for each document with any, places of windows that occurred before."""
    found = windows(docs, width)
    spot = F.struct("__k0", "__k1", "at")
    often = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(spot).alias("first")).where("n > 1")
    later = found.join(often.drop("n"), ["h1", "h2"]).where(spot > F.col("first"))
    return later.groupBy("__k0", "__k1").agg(F.collect_set("at").alias("__later"))


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with repeated lines removed from ``text``.

    Adds ``n_lines`` and ``n_lines_removed`` (lines with a word) and the places of
    the removed lines; columns of these names in ``docs`` are replaced.
    """
    given = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*given).alias("row"), *_order_key())
    joined = rows.join(later_windows(docs, width), ["__k0", "__k1"], "left").withColumn("text", F.col("row")["text"])
    lines = F.split("text", "\n", -1)
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    worded = F.filter(every, lambda i: F.get("lines", i).rlike(HAS_WORD))
    covered = F.flatten(F.transform("__later", lambda j: F.array(*(F.get("worded", j + k) for k in range(width)))))
    left = F.array_except(every, F.col("gone"))
    text = F.when(F.size("gone") > 0, F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")).otherwise(F.col("text"))
    rows = (
        joined.withColumn("lines", lines)
        .withColumn("worded", F.when(F.col("text").isNotNull(), worded).otherwise(F.array().cast("array<int>")))
        .withColumn("gone", F.coalesce(F.array_sort(F.array_distinct(covered)), F.array().cast("array<int>")))
    )
    return rows.select(
        *(text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in given),
        F.size("worded").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_lines_removed"),
        F.col("gone").alias("removed_lines"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_lines_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents where text is not null),
worded as (
  select *, row_number() over (partition by doc_id order by pos) as place,
         lead(line, 1) over w as l1, lead(line, 2) over w as l2
  from lines where regexp_matches(line, '[^\x20\x09-\x0D]') window w as (partition by doc_id order by pos)),
seen as (
  select doc_id, place, row_number() over (partition by line, l1, l2 order by doc_id, place) as nth
  from worded where l2 is not null),
gone as (select distinct doc_id, place + o as place from seen, (values (0), (1), (2)) t(o) where nth > 1),
rest as (
  select l.doc_id, l.pos, l.line, w.place is not null as has_word, g.place is not null as removed
  from lines l left join worded w using (doc_id, pos) left join gone g on g.doc_id = w.doc_id and g.place = w.place)
select d.doc_id, coalesce(sum(has_word::int), 0)::bigint as n_lines, coalesce(sum(removed::int), 0)::bigint as n_lines_removed,
       case when d.text is null then null
            else sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not removed), '')) end as kept_sha256
from documents d left join rest r using (doc_id) group by d.doc_id, d.text
"""
