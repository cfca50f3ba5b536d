"""Near-duplicate documents by SuperMinHash, banding, exact verification and grouping.

1. *Signatures.*  Each distinct shingle hash draws a lazily shuffled permutation
   of the ``m`` components; in round ``j`` it offers ``j`` plus a uniform fraction
   to the component its permutation has at place ``j``.  Components keep the
   least offer.  The ranks of one shingle are all different, which is what lowers
   the variance against independent hashes.  A document stops as soon as every
   component holds an offer below ``j + 1``; later rounds cannot change it.  The
   rounds run for all documents of a block at once.
2. *Classes.*  Documents with the same shingle set are one class, which from
   here on is one row however many copies it has.
3. *Banding.*  ``bands`` groups of ``rows`` components are hashed into buckets.
   With 38 bands of 6 a pair at similarity 0.8 shares no bucket with probability
   (1 - 0.8**6)**38 = 1e-5, and one at 0.2 shares some with 0.2 per cent.
4. *First links.*  In each bucket every class is paired with the least class of
   the bucket.  Pairs that sizes and signatures do not rule out are verified on
   the full shingle sets of the whole texts.
5. *Remaining links.*  Buckets that still hold several components are searched
   in blocks: the classes outside the bucket's largest component against all of
   its classes, by signature, each pair only in the first bucket that it shares.
   The best pair of every two components of a block is verified first; what then
   is still in different components and not ruled out is verified too.  Pairs
   inside one component need no test, since the result is reachability.
   A block has a bounded number of classes and of shingles, and emits only what
   passes.  A bucket for which a class would enter more than ``FAN`` blocks is
   divided first, by ``SUB_BANDS`` further bands of ``SUB_ROWS`` components each, so
   that a class is copied a fixed number of times however large the bucket is.
6. *Grouping.*  Verified links are grouped by union-find over Spark joins; later
   links only name components, whose own graph is small.

Signatures rule a pair out where fewer than ``threshold - slack`` of the
components agree, four and a half standard deviations below the threshold.  The
further bands miss a pair at similarity 0.8 exactly with probability
(1 - 0.8**8)**60 = 2e-5.  Classes are identified by 64 bits of a 128-bit
fingerprint of the set.

Nulls and empty texts have no shingles and link with nothing; null ids are
allowed, and such a document is the head of its group only where no other
member has an id.  Repeated rows are copies of each other: a class is one row
and has one text, however many copies there are.  Very long texts are hashed
whole, one in a block by itself.  Further columns are not read by
``near_groups`` and pass through ``one_of_each``, whatever their names.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, merge_components
from .storage import SMALL_ROWS, drop, materialize
from .substring_dedup import text_key
from .textblocks import Words, blocks, mix64, ranges, signed

SHINGLE, THRESHOLD, BANDS, ROWS, SLACK = 4, 0.8, 38, 6, 0.12
BLOCK, BLOCK_SHINGLES, FAN, SUB_BANDS, SUB_ROWS = 512, 1 << 22, 16, 60, 8
_GOLDEN = 0x9E3779B97F4A7C15
_ODD = np.uint64(_GOLDEN)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted in each row, and row offsets.

    A row with fewer than ``width`` words has its whole sequence as one shingle.
    """
    words = Words(column, lower=True)
    spans = words.spans()
    n = words.counts
    each = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = ranges(words.first[:-1], each)
    row = np.repeat(np.arange(len(n)), each)
    value = spans.of(at, np.minimum(width, n)[row])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[keep], np.append(0, np.cumsum(np.bincount(row[keep], minlength=len(n))))


def super_minhash(values: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """Signatures (rows x m) of the sets ``values[offsets[i]:offsets[i + 1]]``."""
    n = len(offsets) - 1
    best = np.full(n * m, _NONE)
    row = np.repeat(np.arange(n), np.diff(offsets))
    place = None
    for j in range(m):
        if not len(values):
            break
        draw = mix64(values + np.uint64(_GOLDEN * (j + 1) & (1 << 64) - 1))
        k = j + (((draw & _LOW) * np.uint64(m - j)) >> _32).astype(np.int64)
        every = np.arange(len(values))
        if place is None:
            slot = k
        else:
            slot = place[every, k].astype(np.int64)
            place[every, k] = place[:, j]
            place[:, j] = slot
        np.minimum.at(best, row * m + slot, (np.uint64(j) << _32) | (draw >> _32))
        worst = best.reshape(n, m).max(axis=1)
        go = (worst >= np.uint64(j + 1) << _32)[row]
        if place is None:
            values, row, k = values[go], row[go], k[go]
            place = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(values), 1))
            place[np.arange(len(values)), k] = 0
            place[:, 0] = k
        elif not go.all():
            values, row, place = values[go], row[go], place[go]
    return best.reshape(n, m)


def _signatures(width: int, bands: int, rows: int):
    m = bands * rows

    def run(batches):
        for block in blocks(batches):
            values, offsets = shingle_sets(block.column(3), width)
            size = np.diff(offsets)
            signature = super_minhash(values, offsets, m)
            folded = mix64(signature + np.arange(m, dtype=np.uint64) * _ODD).reshape(len(size), bands, rows)
            bucket = mix64(folded.sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
            total = [np.append(np.zeros(1, np.uint64), np.cumsum(mix64(values + np.uint64(c)), dtype=np.uint64)) for c in (1, 2)]
            print_ = [mix64(t[offsets[1:]] - t[offsets[:-1]] + size.astype(np.uint64)) for t in total]
            yield pa.record_batch(
                [
                    *block.columns[:3],
                    pa.array(size.astype(np.int64)),
                    *(pa.array(signed(x)) for x in print_),
                    pa.array(list(signed(bucket))) if len(size) else pa.array([], pa.list_(pa.int64())),
                    pa.array([x.tobytes() for x in (signature & np.uint64(255)).astype(np.uint8)], pa.binary()),
                    pa.array([x.tobytes() for x in (bucket & _LOW).astype(np.uint32)], pa.binary()),
                ],
                ["doc_id", "k0", "k1", "n_shingles", "cid", "f1", "buckets", "sig", "mark"],
            )

    return run


def _agree(batches):
    """Share of equal signature components of each pair."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
        yield pa.record_batch([*batch.columns[:2], pa.array((a == b).mean(axis=1))], ["a", "b", "est"])


def _by_block(batches):
    """Tables with all rows of a block; rows come sorted by block, the first column."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), batch.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if held and block[x] != key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
            key = block[x]
    if held:
        yield pa.Table.from_batches(held)


@cache
def _sub_bands(m: int) -> np.ndarray:
    """The components of each further band (SUB_BANDS x SUB_ROWS)."""
    rng = np.random.default_rng(11)
    return np.array([rng.choice(m, SUB_ROWS, replace=False) for _ in range(SUB_BANDS)])


def _divide(m: int):
    """Rows of large buckets, once in each of the bucket's further bands; ``sub`` is its number."""
    bands = _sub_bands(m)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            own = np.ascontiguousarray(sig[:, bands.T].transpose(2, 0, 1)).view(np.uint64)[:, :, 0]  # bands x rows
            bucket = batch.column(1).to_numpy().view(np.uint64)
            key = mix64(mix64(own + np.arange(len(bands), dtype=np.uint64)[:, None] * _ODD) ^ bucket)
            at = pa.array(np.tile(np.arange(batch.num_rows), len(bands)))
            sub = np.repeat(np.arange(len(bands), dtype=np.int32), batch.num_rows)
            yield pa.record_batch(
                [batch.column(0).take(at), pa.array(signed(key.ravel())), batch.column(2).take(at), pa.array(sub), *(batch.column(i).take(at) for i in (3, 4))],
                ["cid", "bucket", "band", "sub", "n", "label"],
            )

    return run


def _possible(t: pa.Table, least: float, ratio: float):
    """For each query row of a block the rows of other components that sizes and
    signatures do not rule out and that share no earlier bucket with it, and how
    many components of the signature agree."""
    query = t.column("query").to_numpy()
    label, n, band, sub = (t.column(x).to_numpy() for x in ("label", "n", "band", "sub"))
    sig, mark = (np.frombuffer(b"".join(t.column(x).to_pylist()), kind).reshape(t.num_rows, -1) for x, kind in (("sig", np.uint8), ("mark", np.uint32)))
    rest = np.flatnonzero(~query)
    earlier = _sub_bands(sig.shape[1])[: sub[0]].ravel() if sub[0] > 0 else ()  # a block is of one further band
    for i in np.flatnonzero(query):
        other = rest[label[rest] != label[i]]
        other = other[np.minimum(n[other], n[i]) >= ratio * np.maximum(n[other], n[i])]
        agree = (sig[other] == sig[i]).sum(axis=1)
        new = (agree >= least * sig.shape[1]) & (mark[other, : band[i]] != mark[i, : band[i]]).all(axis=1)
        if len(earlier) and new.any():
            same = sig[other[new]][:, earlier] == sig[i, earlier]
            new[new] = ~same.reshape(len(same), -1, SUB_ROWS).all(axis=2).any(axis=1)
        if new.any():
            yield i, other[new], agree[new]


def _best_pairs(least: float, ratio: float):
    """The pair with the most agreement of every two components of a block, and the components."""

    def run(batches):
        for t in _by_block(batches):
            cid, label = t.column("cid").to_numpy(), t.column("label").to_numpy()
            best: dict = {}
            for i, other, agree in _possible(t, least, ratio):
                for j in np.unique(label[other]):
                    own = np.flatnonzero(label[other] == j)
                    top = own[np.lexsort((cid[other][own], -agree[own]))[0]]
                    found = (-int(agree[top]), *sorted((int(cid[i]), int(cid[other[top]]))))
                    sides = tuple(sorted((int(label[i]), int(j))))
                    best[sides] = min(best.get(sides, found), found)
            rows = [(x[1], x[2], *sides) for sides, x in best.items()]
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["a", "b", "la", "lb"])

    return run


def _possible_rows(least: float, ratio: float):
    """The rows of each block that take part in some possible pair."""

    def run(batches):
        for t in _by_block(batches):
            some = np.zeros(t.num_rows, bool)
            for i, other, _ in _possible(t, least, ratio):
                some[i] = True
                some[other] = True
            yield from t.filter(pa.array(some)).to_batches()

    return run


def _verify_blocks(width: int, threshold: float, least: float, ratio: float):
    """Components of a block with a pair whose full shingle sets meet the threshold."""
    percent = round(100 * threshold)

    def run(batches):
        for t in _by_block(batches):
            t = t.combine_chunks()
            label = t.column("label").to_numpy()
            value, at = shingle_sets(t.column("text").chunk(0), width)
            size = np.diff(at)
            out = [[], []]
            for i, other, _ in _possible(t, least, ratio):
                own = value[at[i] : at[i + 1]]
                theirs = value[ranges(at[other], size[other])]
                hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                both = np.add.reduceat(hit, np.append(0, np.cumsum(size[other]))[:-1], dtype=np.int64)
                linked = other[100 * both >= percent * (size[i] + size[other] - both)]
                out[0].append(np.minimum(label[linked], label[i]))
                out[1].append(np.maximum(label[linked], label[i]))
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
            found = np.unique(np.stack([a, b], axis=1), axis=0)
            yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], ["la", "lb"])

    return run


def _verify(width: int, threshold: float, keep: list[str]):
    """The columns ``keep`` of the rows whose two texts, the last columns, meet the threshold."""
    percent = round(100 * threshold)

    def run(batches):
        for block in blocks(batches, "ta"):
            va, oa = shingle_sets(block.column(len(keep)), width)
            vb, ob = shingle_sets(block.column(len(keep) + 1), width)
            ok = np.zeros(block.num_rows, bool)
            for i in range(block.num_rows):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.record_batch(list(block.filter(pa.array(ok)).columns[: len(keep)]), keep)

    return run


def class_texts(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """``cid, text``: one text of each class of ``wanted(cid, k0, k1)``.

    Copies of a row are taken together before anything is shuffled.
    """
    if wanted.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        rows = keyed.select("k0", "k1", "text").join(F.broadcast(wanted), ["k0", "k1"]).groupBy("cid").agg(F.first("text").alias("text"))
    else:
        rows = keyed.groupBy("k0", "k1").agg(F.first("text").alias("text")).join(wanted, ["k0", "k1"]).select("cid", "text")
    texts = materialize(rows, "texts")
    drop(wanted)
    return texts


def near_groups(docs: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, slack: float = SLACK) -> DataFrame:
    """``doc_id, k0, k1, n_shingles, group, component_id, kept`` for each row of ``docs(doc_id, text)``.

    ``group`` identifies the component also where ids are null or repeated (null without shingles).

    ``k0, k1`` address the row by content.  Rows that
    share ``k0, k1`` are equal and get equal results.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), "text")
    sig = keyed.mapInArrow(
        _signatures(width, bands, rows),
        "doc_id long, k0 long, k1 long, n_shingles long, cid long, f1 long, buckets array<long>, sig binary, mark binary",
    )
    sig = materialize(sig, "signatures")
    filled = sig.where("n_shingles > 0")
    classes = filled.groupBy("cid", "f1").agg(
        F.min("doc_id").alias("head"),
        F.min(F.struct("k0", "k1")).alias("key"),
        F.first("n_shingles").alias("n"),
        F.first("buckets").alias("buckets"),
        F.first("sig").alias("sig"),
        F.first("mark").alias("mark"),
    )
    classes = materialize(classes, "classes")

    in_bucket = classes.select("cid", "n", F.posexplode("buckets").alias("band", "bucket"))
    shared = in_bucket.groupBy("bucket").agg(F.min("cid").alias("lead"), F.count("*").alias("m")).where("m > 1").select("bucket", "lead")
    members = materialize(in_bucket.join(shared, "bucket"), "members")
    signatures = classes.select("cid", "sig", "n")

    def compared(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and signatures do not rule out the threshold."""
        a = signatures.select(F.col("cid").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
        b = signatures.select(F.col("cid").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
        near = pairs.join(b, "b").join(a, "a").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
        return near.select("a", "b", "sa", "sb").mapInArrow(_agree, "a long, b long, est double").where(F.col("est") >= threshold - slack)

    stars = members.where("cid <> lead").select(F.col("lead").alias("a"), F.col("cid").alias("b")).distinct()
    first = materialize(compared(stars).select("a", "b"), "first-pairs")
    wanted = members.select("cid").distinct().join(classes.select("cid", "key"), "cid").select("cid", "key.k0", "key.k1")
    texts = class_texts(keyed, materialize(wanted, "wanted"))

    def verified(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
        b = texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))
        keep = pairs.columns
        return pairs.join(b, "b").join(a, "a").select(*keep, "ta", "tb").mapInArrow(_verify(width, threshold, keep), ", ".join(f"{c} long" for c in keep))

    links = materialize(verified(first), "links")
    groups = connected_components(links)
    drop(first, links)

    def mixed(rows: DataFrame) -> DataFrame:
        """Buckets with several groups: their largest group ``main`` and how many ``parts`` they are searched in."""
        counts = rows.groupBy("bucket", "label").agg(F.count("*").alias("m"), F.sum("n").alias("size"))
        each = counts.groupBy("bucket").agg(
            F.count("*").alias("labels"), F.sum("m").alias("members"), F.sum("size").alias("size"), F.max_by("label", F.struct("m", "label")).alias("main"), F.max("m").alias("largest")
        )
        parts = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES))
        wide = F.least(parts, F.col("members") - F.col("largest")) > FAN
        return each.where("labels > 1").select("bucket", "main", parts.alias("parts"), wide.alias("wide"))

    def mixed_blocks(groups: DataFrame) -> DataFrame:
        """Blocks of the buckets with several groups: the classes outside the largest as queries, and all."""
        label = members.select("bucket", "band", "cid", "n").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
        label = materialize(label.select("cid", "bucket", "band", F.lit(-1).alias("sub"), "n", F.coalesce("component", "cid").alias("label")), "labelled")
        found = materialize(mixed(label), "mixed")
        open_ = label.join(found.where("not wide").drop("wide"), "bucket")
        if not found.where("wide").isEmpty():
            wide = label.join(found.where("wide").select("bucket"), "bucket").join(classes.select("cid", "sig"), "cid")
            part = wide.select("cid", "bucket", "band", "n", "label", "sig").mapInArrow(_divide(bands * rows), label.schema)
            part = materialize(part, "divided")
            open_ = open_.unionByName(part.join(mixed(part).drop("wide"), "bucket"))
        open_ = open_.join(classes.select("cid", "sig", "mark"), "cid")
        own = F.pmod(F.xxhash64("cid", "bucket"), F.col("parts"))
        every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
        ask = open_.where(F.col("label") != F.col("main")).withColumn("query", F.lit(True)).withColumn("q", own).withColumn("r", F.explode(every))
        answer = open_.withColumn("query", F.lit(False)).withColumn("r", own).join(ask.select("bucket", "q").distinct(), "bucket")
        block = F.xxhash64("bucket", "q", "r").alias("block")
        columns = (block, "query", "cid", "label", "n", "band", "sub", "sig", "mark")
        return ask.select(*columns).unionByName(answer.select(*columns)).repartition("block").sortWithinPartitions("block")

    limits = (threshold - slack, threshold)
    best = mixed_blocks(groups).mapInArrow(_best_pairs(*limits), "a long, b long, la long, lb long").distinct()
    links = materialize(verified(best), "best-links")
    groups = merge_components(groups, links)
    drop(links)

    open_rows = mixed_blocks(groups)
    possible = materialize(open_rows.mapInArrow(_possible_rows(*limits), open_rows.schema), "possible")
    rest = possible.join(texts, "cid").select(*open_rows.columns, "text").repartition("block").sortWithinPartitions("block")
    links = materialize(rest.mapInArrow(_verify_blocks(width, threshold, *limits), "la long, lb long").distinct(), "last-links")
    groups = merge_components(groups, links)
    drop(links, possible, texts, members)

    heads = classes.select("cid", "f1", "head").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
    heads = heads.withColumn("component", F.coalesce("component", "cid"))
    least = heads.groupBy("component").agg(F.min("head").alias("component_id"))
    of_class = heads.join(least, "component").select("cid", "f1", F.col("component").alias("group"), "component_id")
    some = filled.select("doc_id", "k0", "k1", "n_shingles", "cid", "f1").join(of_class, ["cid", "f1"])
    none = sig.where("n_shingles = 0").withColumn("group", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    out = some.drop("cid", "f1").unionByName(none.select("doc_id", "k0", "k1", "n_shingles", "group", "component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: the head of each group, and all rows without shingles.

    Where rows share the head's id, the one with the least text hash stays.
    """
    groups = materialize(near_groups(docs, **options), "near-groups")
    heads = groups.where("kept and group is not null").groupBy("group").agg(F.min(F.struct("k0", "k1")).alias("k")).select("k.*")
    none = groups.where("group is null").select("k0", "k1", F.lit(False).alias("grouped"))
    stay = heads.withColumn("grouped", F.lit(True)).unionByName(none).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), *text_key())
    kept = rows.join(stay, ["k0", "k1"])
    kept = kept.withColumn("one", F.when(F.col("grouped"), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id()))
    return kept.dropDuplicates(["k0", "k1", "one"]).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select("doc_id", "n_shingles", "component_id", "kept")
