"""Ordered-sequence operators that do not funnel a long order through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INTERVALS, SAMPLE = 64, 4096


def splits_of(df: DataFrame, key: str, intervals: int = INTERVALS) -> list[int]:
    """About equal-count cut points of a long key: at most ``intervals`` numbers reach the driver."""
    share = [i / intervals for i in range(1, intervals)]
    row = df.agg(F.percentile_approx(key, share, 8 * intervals).alias("s")).first()
    return sorted(set(row.s or []))


def interval(key: Column, splits: list[int]) -> Column:
    """Number of cut points at or below the key."""
    return sum(((key >= x).cast("int") for x in splits), F.lit(0))


def prefix_sum(df: DataFrame, key: str, value: str, out: str, intervals: int = INTERVALS) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows of smaller ``key`` (keys are unique longs).

    Interval totals are accumulated over at most ``intervals`` rows; each interval
    finishes its own sum, so the work spreads over the cluster.
    """
    parts = df.withColumn("__interval", interval(F.col(key), splits_of(df, key, intervals)))
    before = W.orderBy("__interval").rowsBetween(W.unboundedPreceding, -1)
    total = parts.groupBy("__interval").agg(F.sum(value).alias("__sum"))
    total = total.select("__interval", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inner = W.partitionBy("__interval").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    joined = parts.join(F.broadcast(total), "__interval")  # at most ``intervals`` rows
    return joined.withColumn(out, F.col("__before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("__interval", "__before")


def sampled_splits(df: DataFrame, key: str, intervals: int = INTERVALS) -> list:
    """About equal-count cut points of a key of any ordered type, from the ``SAMPLE`` rows of least hash."""
    rows = df.select(F.col(key).alias("k")).where("k is not null").orderBy(F.xxhash64("k"), "k").limit(SAMPLE).collect()
    values = sorted(r.k for r in rows)
    return sorted({values[i * len(values) // intervals] for i in range(1, intervals)}) if values else []


def numbered(df: DataFrame, key: str, order: list, out: str, intervals: int = INTERVALS, like: DataFrame | None = None) -> DataFrame:
    """``df`` with ``out``, the row number from 1 in the order of ``order``, which begins with ``key`` (null last).

    Each interval of the key numbers its own rows; the cut points come from
    ``like`` where its column ``key`` is cheaper to read.
    """
    cuts = sampled_splits(df if like is None else like, key, intervals)
    place = sum(((F.col(key) >= F.lit(x)).cast("int") for x in cuts), F.lit(0))
    parts = df.withColumn("__interval", F.coalesce(place, F.lit(len(cuts))))
    before = W.orderBy("__interval").rowsBetween(W.unboundedPreceding, -1)
    sizes = parts.groupBy("__interval").agg(F.count("*").alias("__n"))
    sizes = sizes.select("__interval", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = W.partitionBy("__interval").orderBy(*order)
    joined = parts.join(F.broadcast(sizes), "__interval")  # at most ``intervals`` rows
    return joined.withColumn(out, F.col("__before") + F.row_number().over(inner)).drop("__interval", "__before")


def scans(df: DataFrame, key: str, sums: dict[str, Column] | None = None, least: dict[str, Column] | None = None, intervals: int = INTERVALS) -> DataFrame:
    """``df`` with running sums and running minima up to and including each row of a unique long ``key``."""
    wanted = {**{k: (F.sum, c) for k, c in (sums or {}).items()}, **{k: (F.min, c) for k, c in (least or {}).items()}}
    parts = df.withColumn("__interval", interval(F.col(key), splits_of(df, key, intervals)))
    before = W.orderBy("__interval").rowsBetween(W.unboundedPreceding, -1)
    totals = parts.groupBy("__interval").agg(*(f(c).alias(k) for k, (f, c) in wanted.items()))
    totals = totals.select("__interval", *(f(k).over(before).alias(f"__{k}") for k, (f, _) in wanted.items()))
    inner = W.partitionBy("__interval").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    joined = parts.join(F.broadcast(totals), "__interval")  # at most ``intervals`` rows
    both = {k: F.least(F.col(f"__{k}"), f(c).over(inner)) if f is F.min else F.coalesce(F.col(f"__{k}"), F.lit(0.0)) + f(c).over(inner) for k, (f, c) in wanted.items()}
    return joined.withColumns(both).drop("__interval", *(f"__{k}" for k in wanted))


def two_before(df: DataFrame, group: str, place: str, n: int, intervals: int = INTERVALS) -> DataFrame:
    """``df`` with ``prev1`` and ``prev2``, the two places before each row's in its group; places are 1, 2, ... ``n``.

    Windows run over (group, interval), not over whole groups, so a group that
    holds most rows is spread; what crosses an interval's edge comes from a
    table with two places for each group and interval.
    """
    parts = df.withColumn("__interval", F.floor((F.col(place) - 1) * min(intervals, n) / max(1, n)).cast("int"))
    inner = W.partitionBy(group, "__interval").orderBy(place)
    parts = parts.withColumns({"prev1": F.lag(place, 1).over(inner), "prev2": F.lag(place, 2).over(inner)})
    last = parts.groupBy(group, "__interval").agg(F.max(place).alias("__l1"), F.max("prev1").alias("__l2"))
    chain = W.partitionBy(group).orderBy("__interval")
    edge = last.select(
        group,
        "__interval",
        F.lag("__l1", 1).over(chain).alias("__e1"),
        F.coalesce(F.lag("__l2", 1).over(chain), F.lag("__l1", 2).over(chain)).alias("__e2"),
    )
    joined = parts.join(edge, [group, "__interval"])
    return joined.withColumns({
        "prev2": F.when(F.col("prev1").isNull(), F.col("__e2")).otherwise(F.coalesce("prev2", "__e1")),
        "prev1": F.coalesce("prev1", "__e1"),
    }).drop("__interval", "__e1", "__e2")


def runs(df: DataFrame, keys: list[str], order: list[str], same: list[str]) -> DataFrame:
    """``df`` with ``run``, the number of its maximal run of rows with equal ``same`` columns."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = F.lit(False)
    for c in same:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("__new", (F.row_number().over(w) == 1) | new).withColumn("run", F.sum(F.col("__new").cast("int")).over(w)).drop("__new")


def bigrams(df: DataFrame, keys: list[str], order: list[str], symbol: str, lag: int = 1) -> DataFrame:
    """Adjacent symbols of each sequence: ``keys, from, to``."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.select(*keys, F.col(symbol).alias("from"), F.lead(symbol, lag).over(w).alias("to")).where("`to` is not null")
