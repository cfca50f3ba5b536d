"""Sharding by a Hilbert curve over several metadata dimensions.

Source, language and size are quantised to ``bits`` bits each.  Source and
language become the share of rows whose value is smaller, so frequent values get
room; size becomes its logarithm.  The cell's index on the Hilbert curve orders
the rows, with a hash of the id behind it, and the order is cut into runs of near
equal bytes.  Neighbouring cells differ little in every dimension, so each shard
spans a small box and readers can prune files by any of the dimensions.

The global prefix sum of bytes is taken in two steps: quantiles of the sort key
(their number follows the row count, within bounds) make intervals of about equal
row counts, whose totals are accumulated; inside an interval a window finishes
the sum.  No value of any dimension, however frequent, is a window of its own,
because the id's hash splits it.

A row goes to the shard that holds its middle byte, so shards differ from the
mean by less than one row on each side.  Slots count rows inside a shard in the
same order.

Nulls: a null text has size 1 (0 bytes plus 1), null source and language come
before all values, a null id hashes like the text ``null``.  Equal rows are
neighbours.  With fewer rows than shards some shards stay empty; an empty table
gives no rows.  Further columns, whatever their names, are not read.  A very long
text is one row of many bytes, and its shard is larger by at most that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import numbered, scans
from .storage import if_small, materialize

SHARDS, BITS, DIMENSIONS = 16, 8, ("source", "lang", "size")
INTERVALS = (256, 8192)
ROWS_PER_INTERVAL = 20_000


def hilbert_index(coordinates: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with ``bits``-bit coordinates.

    The curve visits the cells of a cube by entering sub-cubes in Gray code
    order; from the top bit down, each level's bits decide how the axes of the
    levels below are flipped or exchanged.
    """
    x = np.array(coordinates, np.int64)
    n = len(x)
    for level in range(bits - 1, -1, -1):
        below = (1 << level) - 1
        for axis in range(n):
            upper = (x[axis] >> level) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ x[axis]) & below)
            x[0] = np.where(upper, x[0] ^ below, x[0] ^ swap)
            x[axis] = x[axis] ^ swap if axis else x[0]
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            index = index << 1 | (x[axis] >> level) & 1
    return index


def quantised(docs: DataFrame, column: str, bits: int) -> DataFrame:
    """``none, value, place``: each value's share of smaller rows, in ``bits`` bits."""
    some = F.col(column).isNotNull()
    each = docs.groupBy(some.alias("some"), F.coalesce(column, F.lit("")).alias("value")).agg(F.count("*").alias("n"))
    each = materialize(each.withColumn("by", F.concat(F.col("some").cast("int").cast("string"), "value")), f"counts-{column}")
    placed = materialize(numbered(each, "by", ["by"], "nth"), f"numbers-{column}")
    placed = scans(placed, "nth", sums={"upto": F.col("n")})
    total = each.agg(F.sum("n").alias("total"))  # one row
    before = (F.col("upto") - F.col("n")).cast("long")
    return placed.crossJoin(F.broadcast(total)).select("some", "value", F.floor(before * (1 << bits) / F.col("total")).cast("int").alias("place"))


def key_udf(bits: int, tail: int):
    @F.pandas_udf("long")
    def key(source: pd.Series, lang: pd.Series, size: pd.Series, low: pd.Series) -> pd.Series:
        log = np.minimum(np.log2(size.to_numpy()) * (1 << bits) / 32, (1 << bits) - 1).astype(np.int64)
        index = hilbert_index([source.to_numpy(), lang.to_numpy(), log], bits)
        return pd.Series(index << tail | low.to_numpy())

    return key


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, hilbert`` for each row of ``docs(doc_id, text, source, lang)``.

    With ``carry`` also ``row``, a struct of these columns.
    """
    row = [F.struct(*carry).alias("row")] if carry else []
    tail = 62 - 3 * bits
    low = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.col("source").isNotNull().alias("s_some"),
        F.coalesce("source", F.lit("")).alias("s_value"),
        F.col("lang").isNotNull().alias("l_some"),
        F.coalesce("lang", F.lit("")).alias("l_value"),
        F.shiftright(low, 60 - tail).alias("low"),
        *row,
    )
    for column, tag in (("source", "s"), ("lang", "l")):
        table = materialize(quantised(docs, column, bits), f"places-{column}")
        table = table.select(F.col("some").alias(f"{tag}_some"), F.col("value").alias(f"{tag}_value"), F.col("place").alias(f"{tag}_place"))
        rows = rows.join(if_small(table), [f"{tag}_some", f"{tag}_value"])
    key = key_udf(bits, tail)("s_place", "l_place", "size", "low")
    rest = ["row"] if carry else []
    rows = materialize(rows.select("doc_id", "size", "text_crc32", key.alias("key"), *rest), "shard-keys")

    n = rows.count()
    intervals = int(min(max(n // ROWS_PER_INTERVAL, INTERVALS[0]), INTERVALS[1]))
    share = [i / intervals for i in range(1, intervals)]
    splits = rows.agg(F.percentile_approx("key", share, 4 * intervals).alias("s")).first().s if n else []
    splits = np.unique(np.array(splits, np.int64))

    @F.pandas_udf("int")
    def interval(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, key.to_numpy(), "right").astype(np.int32))

    rows = rows.withColumn("interval", interval("key"))
    total = rows.groupBy("interval").agg(F.sum("size").alias("bytes"))
    up = W.orderBy("interval").rowsBetween(W.unboundedPreceding, -1)
    total = total.select("interval", F.coalesce(F.sum("bytes").over(up), F.lit(0)).alias("before"), F.sum("bytes").over(W.partitionBy()).alias("all"))
    order = W.partitionBy("interval").orderBy("key", "doc_id", "text_crc32", "size")
    done = F.col("before") + F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shard = F.least(F.lit(shards - 1), F.floor((2 * done + F.col("size")) * shards / (2 * F.col("all")))).cast("int")
    # at most INTERVALS[1] rows of totals
    placed = rows.join(F.broadcast(total), "interval").select("*", shard.alias("shard"), F.row_number().over(order).alias("nth"))
    placed = materialize(placed.drop("before", "all"), "shard-rows")
    # One row for each shard that an interval reaches: at most INTERVALS[1] + shards.
    parts = placed.groupBy("shard", "interval").agg(F.count("*").alias("n"), F.min("nth").alias("from"))
    earlier = W.partitionBy("shard").orderBy("interval").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("shard", "interval", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("from")).alias("offset"))
    slot = (F.col("offset") + F.col("nth")).cast("long")
    return placed.join(F.broadcast(parts), ["shard", "interval"]).select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"), F.shiftright("key", tail).alias("hilbert"), *rest)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write ``docs`` partitioned by shard, in curve order inside each; a column ``shard`` is replaced.

    The order is cut into as many tasks as the session shuffles to, so a shard is
    several files, each a run of the curve.
    """
    columns = [c for c in docs.columns if c != "shard"]
    rows = hilbert_shards(docs, shards, carry=columns)
    rows = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.select(*(F.col("row")[c].alias(c) for c in columns), "shard").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    out = hilbert_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
