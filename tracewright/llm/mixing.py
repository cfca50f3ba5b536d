"""Mixing sources to target weights by capped water-filling.

Every source has a weight and may be repeated at most ``epochs`` times.  The
budget is shared by weight; a source whose share exceeds its cap is clamped and
the excess goes to the others in proportion, until none is above.  Sorting by
cap over weight gives the fixed point in one pass: sources below the water level
``(budget - caps of the clamped) / weights of the rest`` are clamped.

Each source then takes ``floor(target / size)`` whole repetitions of all its
documents.  The fraction that remains is taken from the documents in the order of
a seeded hash: whole ones until the next would exceed it, and the leading words
of that one, so a source meets its target to the word.  The cut is found by a
histogram of hash buckets per source and then inside the one bucket that holds
it, so a source with a third of all rows is no window of its own, and the texts
are never shuffled while the table of sources is small.

Nulls: a null text has size 0, a null source is a source of its own and comes
last, a null id hashes like the text ``null``.  Rows with the same id share
their hash and, at the cut, the words that are left, in proportion to their
sizes and rounded down.  Sources without words have target 0 and take nothing.  An
empty table gives no rows.  Columns of any name pass through ``mixed_rows``.  A
very long text is counted whole, and cut by an array of its words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import numbered, scans
from .storage import if_small, materialize

WEIGHTS, EPOCHS, BUCKETS, SEED = (5, 2, 1), 3, 4096, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def place(seed: str):
    """60 bits of a seeded hash of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``; one row a source.

    Sources are numbered and their caps and weights summed in intervals, so their
    number does not matter.
    """
    named = materialize(numbered(sizes, "source", [F.col("source").asc_nulls_last()], "nth"), "mix-names")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    sized = named.withColumn("w", w).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    sized = sized.withColumn("level", F.col("cap") / F.col("w"))
    sized = materialize(numbered(sized, "level", ["level", F.col("source").asc_nulls_last()], "place"), "mix-levels")
    sized = materialize(scans(sized, "place", sums={"caps": F.col("cap"), "ws": F.col("w")}), "mix-sums")
    total = sizes.agg(F.sum("source_size").cast("double").alias("budget")).crossJoin(sized.agg(F.sum("w").alias("all_w")))
    sized = sized.crossJoin(F.broadcast(total))  # one row
    sized = sized.withColumn("water", (F.col("budget") - (F.col("caps") - F.col("cap"))) / (F.col("all_w") - F.col("ws") + F.col("w")))
    right = sized.agg(F.min(F.when(F.col("water") <= F.col("level"), F.struct("level", "water"))).alias("right"))
    return sized.crossJoin(F.broadcast(right)).select("source", "source_size", F.least("cap", F.col("w") * F.col("right.water")).alias("target"))


def source_plan(rows: DataFrame, weights, epochs: int, buckets: int) -> DataFrame:
    """One row a source of ``rows(none, name, u, size)``: its target, whole copies and where the fraction ends.

    Documents whose hash is below ``cut`` are taken once more; those at ``cut``
    (one document, unless ids repeat) share ``part`` of their ``at_cut`` words.
    """
    step = (1 << 60) // buckets
    bucket = F.floor(F.col("u") / step).cast("int")
    grid = rows.groupBy("none", "name", bucket.alias("bucket")).agg(F.sum("size").alias("inside"))
    grid = materialize(grid, "mix-grid")
    named = F.when(F.col("none"), None).otherwise(F.col("name"))
    total = grid.groupBy("none", "name").agg(F.sum("inside").alias("source_size")).select(named.alias("source"), "source_size")
    total = materialize(total, "mix-sizes")
    target = source_targets(total, weights, epochs)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    target = target.select(
        F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target",
        copies.alias("copies"), (F.floor("target") - copies * F.col("source_size")).alias("rest"),
    )
    target = materialize(target, "mix-targets")
    before = lambda order, amount: F.coalesce(F.sum(amount).over(W.partitionBy("none", "name").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    crossed = (F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("inside"))
    edge = grid.withColumn("before", before("bucket", "inside")).join(target.select("none", "name", "rest"), ["none", "name"]).where(crossed)
    edge = edge.select("none", "name", "bucket", "before", "rest")
    near = rows.withColumn("bucket", bucket).join(if_small(edge), ["none", "name", "bucket"])
    near = near.groupBy("none", "name", "u", "before", "rest").agg(F.sum("size").alias("inside"))
    near = near.withColumn("before", F.col("before") + before("u", "inside")).where(crossed)
    cut = near.select("none", "name", F.col("u").alias("cut"), (F.col("rest") - F.col("before")).alias("part"), F.col("inside").alias("at_cut"))
    return materialize(target.drop("rest").join(cut, ["none", "name"], "left"), "mix-plan")


ADDED = ("size", "source_size", "target", "copies", "extra")


def mix(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, buckets: int = BUCKETS, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``size, source_size, target, copies, extra``.

    ``copies`` whole repetitions of the document and its first ``extra`` words
    are the mix's share of it.  Columns of these names in ``docs`` are replaced.
    Words are counted once; what follows reads the written counts.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ADDED]
    source = [F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")]
    rows = docs.select(F.struct(*carry).alias("row"), *source, place(seed).alias("u"), n_words().alias("size"))  # whatever the columns are called
    rows = materialize(rows, "mix-rows")
    plan = source_plan(rows.drop("row"), weights, epochs, buckets)
    out = rows.join(if_small(plan), ["none", "name"])
    part = F.floor(F.col("size") * F.col("part") / F.col("at_cut"))
    extra = F.when(F.col("u") < F.col("cut"), F.col("size")).when(F.col("u") == F.col("cut"), part).otherwise(0).cast("long")
    return out.select(*(F.col("row")[c].alias(c) for c in carry), "size", "source_size", "target", "copies", extra.alias("extra"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns.

    A document of which only some words are taken appears with those, joined by
    one space.
    """
    given = docs.columns
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("doc")["text"], F.lit(f"({WORD})"), 0), F.lit(1), F.col("extra").cast("int")), " ")
    mixed = mix(docs.select(F.struct(*given).alias("doc"), "doc_id", "source", "text"), carry=["doc"], **options)
    rows = mixed.select("doc", "extra", "size", "copies", F.explode(F.sequence(F.lit(0), F.col("copies"))).alias("nth"))
    rows = rows.where("nth < copies or extra > 0").withColumn("cut", (F.col("nth") == F.col("copies")) & (F.col("extra") < F.col("size")))
    own = lambda c: F.col("doc")[c]
    return rows.select(*((F.when(F.col("cut"), part).otherwise(own(c)) if c == "text" else own(c)).alias(c) for c in given))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, carry=["doc_id"]).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("extra")).alias("taken"))


ORACLE = r"""
with rows as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as u
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         ([5.0, 2.0, 1.0]::double[])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w
  from rows group by source),
level as (
  select *, 3.0::double * source_size as cap,
         coalesce(sum(3.0::double * source_size) over (order by 3.0::double * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as clamped,
         sum(w) over (order by 3.0::double * source_size / w, source nulls last rows between current row and unbounded following) as open_w,
         (sum(source_size) over ())::double as budget
  from s),
water as (select arg_min((budget - clamped) / open_w, cap / w) as water from level where (budget - clamped) / open_w <= cap / w),
t as (
  select source, source_size, least(cap, w * water) as target,
         case when source_size > 0 then floor(least(cap, w * water) / source_size)::bigint else 0 end as copies
  from level, water),
part as (
  select r.*, t.source_size, t.target, t.copies, floor(t.target)::bigint - t.copies * t.source_size as rest,
         coalesce(sum(r.size) over (partition by r.source order by r.u, r.doc_id, r.size rows between unbounded preceding and 1 preceding), 0)::bigint as done
  from rows r join t on r.source is not distinct from t.source)
select doc_id, size, source_size, target, copies * size + greatest(0, least(size, rest - done)) as taken from part
"""
