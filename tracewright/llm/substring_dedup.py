"""Exact substring deduplication by compacting a de Bruijn graph of words.

A window of ``k`` words is an edge of the graph whose nodes are the sequences of
``k - 1`` words.  An edge that occurs twice anywhere, in one document or in two,
is repeated, and every word it covers goes.

1. *Paths.*  Consecutive edges of a document that share a minimiser (the least
   hash among their ``m``-word subsequences, the *anchor*) form one path.  Equal
   edges have equal anchors, so what happens to an edge is decided among the
   paths of its anchor.  About one row leaves the scan for 14 edges.
2. *Repeated anchors.*  Anchors are counted; a join keeps the paths of those
   that occur at least twice (or whose path repeats an edge within itself).
3. *Opening.*  If all paths of an anchor are the same sequence, the path has no
   branch: it stays one row and is repeated as a whole.  Where an anchor has
   different paths, those that occur twice are still repeated as a whole; one
   source of each is *opened* into edges, each with the hashes of its two nodes.
4. *Compaction.*  Edges that occur twice are joined to the nodes' degrees in the
   graph of repeated edges.  Runs of repeated edges of a path that pass no
   branching node, and that follow the same other occurrence, become one row.
5. *Verification.*  Each row is a long span with the coordinates of another
   occurrence.  The words at both coordinates are read from the texts, and a span
   counts only if they are the same (by a 128-bit digest of the words).
6. *Spans.*  Verified spans return to their documents and are merged where they
   touch, and the words outside them are kept.

Paths are found by three independent 64-bit values (anchor and two hashes of the
sequence), edges by anchor and edge hash; equal words are told by verification.
Edges and spans are rows throughout, so a very common anchor is many keys.

Nulls: a null text has no words.  Rows are addressed by ``doc_id`` and a hash of
the text, so null or repeated ids are fine and equal rows get equal results.
Texts with fewer than ``k`` words lose nothing.  Any further columns, also those
named like the ones used here, are not read.  An empty table gives no rows.  Very
long texts are hashed whole, one in a block by itself.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import drop, materialize
from .textblocks import Words, blocks, ranges, signed, sliding_min, utf8_buffers

K, M = 35, 8


def text_key(id_col: str = "doc_id", text_col: str = "text") -> list:
    """Columns that address a row by content: id, whether null, text hash."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("k0"),
        F.xxhash64(F.col(text_col), F.col(id_col)).alias("k1"),
    ]


def one_text(keyed: DataFrame) -> DataFrame:
    """One of each group of equal rows, taken together before anything is shuffled."""
    return keyed.groupBy("k0", "k1").agg(F.first("text").alias("text"))


def path_rows(words: Words, k: int, m: int):
    """Paths of a block: row, first edge, number of edges, anchor, self-repeating, and a span hash."""
    n = len(words.starts)
    edges_in = np.maximum(words.counts - k + 1, 0)
    at = ranges(words.first[:-1], edges_in)
    spans = words.spans()
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64), none.astype(bool), spans
    least = sliding_min(spans.of(np.arange(n - m + 1), m), k - m + 1)[at]
    row = np.repeat(np.arange(len(edges_in)), edges_in)
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    edge = spans.of(at, k)
    order = np.argsort(edge, kind="stable")
    again = np.flatnonzero(edge[order[1:]] == edge[order[:-1]])
    path_of = np.cumsum(new) - 1
    same = path_of[order[again]] == path_of[order[again + 1]]
    loops = np.zeros(len(first), bool)
    loops[path_of[order[again[same]]]] = True
    return row[first], at[first], length, least[first], loops, spans


def _anchors(k: int, m: int):
    def run(batches):
        for block in blocks(batches):
            _, _, _, anchor, loops, _ = path_rows(Words(block.column(0)), k, m)
            yield pa.record_batch([pa.array(signed(anchor)), pa.array(loops)], ["anchor", "loops"])

    return run


def _paths(k: int, m: int):
    def run(batches):
        for block in blocks(batches):
            words = Words(block.column(2))
            row, at, length, anchor, loops, spans = path_rows(words, k, m)
            start = at - words.first[:-1][row]
            yield pa.record_batch(
                [
                    block.column(0).take(pa.array(row)),
                    block.column(1).take(pa.array(row)),
                    pa.array(signed(anchor)),
                    pa.array(signed(spans.of(at, length + k - 1))),
                    pa.array(signed(words.spans(1).of(at, length + k - 1))),
                    pa.array(start.astype(np.int32)),
                    pa.array(length.astype(np.int32)),
                    pa.array(loops),
                ],
                ["k0", "k1", "anchor", "p1", "p2", "start", "edges", "loops"],
            )

    return run


def _open_paths(k: int):
    """Edges of the paths to open, at their coordinates in the text, with their nodes."""

    def run(batches):
        for block in blocks(batches):
            words = Words(block.column(2))
            spans = words.spans()
            todo = block.column(3)
            counts = np.diff(np.frombuffer(todo.buffers()[1], np.int32)[todo.offset : todo.offset + len(todo) + 1])
            paths = todo.flatten()
            start, edges = (np.asarray(paths.field(x)).astype(np.int64) for x in ("start", "edges"))
            path = np.repeat(np.arange(len(start)), edges)
            row = np.repeat(np.arange(len(counts)), counts)
            at = ranges(start, edges)
            place = at + words.first[:-1][row[path]]
            yield pa.record_batch(
                [
                    block.column(0).take(pa.array(row[path])),
                    block.column(1).take(pa.array(row[path])),
                    paths.field("anchor").take(pa.array(path)),
                    pa.array(start[path].astype(np.int32)),
                    pa.array(at.astype(np.int32)),
                    pa.array(signed(spans.of(place, k))),
                    pa.array(signed(spans.of(place, k - 1))),
                    pa.array(signed(spans.of(place + 1, k - 1))),
                ],
                ["k0", "k1", "anchor", "path", "at", "edge", "source", "target"],
            )

    return run


def compacted(edges: DataFrame) -> DataFrame:
    """``k0, k1, start, edges`` and the other occurrence ``o0, o1, o_start`` of nonbranching runs of repeated edges."""
    spot = F.struct("k0", "k1", "at")
    repeated = edges.groupBy("anchor", "edge").agg(
        F.count("*").alias("n"), F.min(spot).alias("lo"), F.max(spot).alias("hi"), F.first("source").alias("source"), F.first("target").alias("target")
    )
    repeated = materialize(repeated.where("n > 1").drop("n"), "repeated-edges")
    ends = repeated.select(F.col("source").alias("node"), F.lit(1).alias("leaving"), F.lit(0).alias("entering"))
    ends = ends.unionByName(repeated.select(F.col("target").alias("node"), F.lit(0).alias("leaving"), F.lit(1).alias("entering")))
    branching = ends.groupBy("node").agg(F.sum("leaving").alias("leaving"), F.sum("entering").alias("entering")).where("leaving > 1 or entering > 1")
    known = repeated.join(branching.select("node"), F.col("source") == F.col("node"), "left")
    known = known.select("anchor", "edge", "lo", "hi", F.col("node").isNotNull().alias("branches"))
    rows = edges.select("k0", "k1", "anchor", "path", "at", "edge").join(known, ["anchor", "edge"])
    other = F.when(F.col("lo") == spot, F.col("hi")).otherwise(F.col("lo"))
    rows = rows.select("k0", "k1", "path", "at", "branches", other.alias("o"))
    w = W.partitionBy("k0", "k1", "path").orderBy("at")
    follows = (F.lag("at").over(w) == F.col("at") - 1) & ~F.col("branches")
    follows &= (F.lag("o.k0").over(w) == F.col("o.k0")) & (F.lag("o.k1").over(w) == F.col("o.k1")) & (F.lag("o.at").over(w) == F.col("o.at") - 1)
    rows = rows.withColumn("new", F.coalesce((~follows).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    runs = rows.groupBy("k0", "k1", "path", "run").agg(F.min("at").alias("start"), F.count("*").cast("int").alias("edges"), F.min("o").alias("o"))
    return runs.select("k0", "k1", "start", "edges", F.col("o.k0").alias("o0"), F.col("o.k1").alias("o1"), F.col("o.at").alias("o_start"))


def _digests(k: int):
    """A digest of the words of each span, as they are in the text."""

    def run(batches):
        for block in blocks(batches):
            data, offsets = utf8_buffers(block.column(2))
            raw = data.tobytes()
            out: list[list] = [[], [], []]
            counts = []
            for i, spans in enumerate(block.column(3).to_pylist()):
                words = raw[offsets[i] : offsets[i + 1]].split()
                counts.append(len(spans))
                for span in spans:
                    a, n = span["start"], span["edges"]
                    value = hashlib.blake2b(b" ".join(words[a : a + n + k - 1]), digest_size=16).digest()
                    for column, x in zip(out, (a, n, value), strict=True):
                        column.append(x)
            row = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.record_batch(
                [block.column(0).take(row), block.column(1).take(row), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())],
                ["k0", "k1", "start", "edges", "digest"],
            )

    return run


def verified(spans: DataFrame, keyed: DataFrame, k: int) -> DataFrame:
    """The spans whose words are those at the other occurrence."""
    own = ["k0", "k1", "start", "edges"]
    other = spans.select(F.col("o0").alias("k0"), F.col("o1").alias("k1"), F.col("o_start").alias("start"), "edges")
    needed = spans.select(*own).unionByName(other).groupBy("k0", "k1").agg(F.collect_set(F.struct("start", "edges")).alias("spans"))
    texts = one_text(keyed).join(needed, ["k0", "k1"]).mapInArrow(_digests(k), "k0 long, k1 long, start int, edges int, digest binary")
    digest = materialize(texts, "digests")
    theirs = digest.select(F.col("k0").alias("o0"), F.col("k1").alias("o1"), F.col("start").alias("o_start"), "edges", F.col("digest").alias("theirs"))
    return spans.join(digest, own).join(theirs, ["o0", "o1", "o_start", "edges"]).where("digest = theirs").select(*own)


def repeated_spans(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """``k0, k1, spans``: for each row with any, its repeated runs of edges (first word, edges)."""
    anchors = docs.select("text").mapInArrow(_anchors(k, m), "anchor long, loops boolean")
    often = anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.max("loops").alias("any")).where("n > 1 or any").select("anchor")
    keyed = docs.select(*text_key(), "text")
    path = keyed.mapInArrow(_paths(k, m), "k0 long, k1 long, anchor long, p1 long, p2 long, start int, edges int, loops boolean")
    found = materialize(path.join(often, "anchor"), "paths")

    spot = F.struct("k0", "k1", "start")
    distinct = found.groupBy("anchor", "p1", "p2").agg(F.count("*").alias("n"), F.max("loops").alias("loops"), F.max("edges").alias("edges"), F.min(spot).alias("lo"), F.max(spot).alias("hi"))
    distinct = materialize(distinct, "distinct-paths")
    branching = distinct.groupBy("anchor").agg((F.count("*") > 1).alias("branches"), F.max("loops").alias("any")).where("branches or any")
    whole = found.join(distinct.where("n > 1").select("anchor", "p1", "p2", "lo", "hi"), ["anchor", "p1", "p2"])
    other = F.when(F.col("lo") == spot, F.col("hi")).otherwise(F.col("lo"))
    whole = whole.withColumn("o", other).select("k0", "k1", "start", "edges", F.col("o.k0").alias("o0"), F.col("o.k1").alias("o1"), F.col("o.start").alias("o_start"))
    opened = (
        distinct.join(branching.select("anchor"), "anchor")
        .select("anchor", "lo.*", "edges")
        .groupBy("k0", "k1")
        .agg(F.collect_list(F.struct("anchor", "start", "edges")).alias("todo"))
    )
    edges = one_text(keyed).join(opened, ["k0", "k1"]).mapInArrow(_open_paths(k), "k0 long, k1 long, anchor long, path int, at int, edge long, source long, target long")
    edges = materialize(edges, "edges")
    spans = materialize(whole.unionByName(compacted(edges)), "spans")
    drop(found, distinct, edges)
    spans = materialize(verified(spans, keyed, k), "verified-spans")
    return spans.groupBy("k0", "k1").agg(F.collect_set(F.struct("start", "edges")).alias("spans"))


def _kept(k: int):
    def run(batches):
        for block in blocks(batches):
            data, offsets = utf8_buffers(block.column(block.schema.get_field_index("text")))
            raw = data.tobytes()
            spans = block.column(block.schema.get_field_index("spans"))
            kept, n_words, n_removed, removed = [], [], [], []
            for i in range(block.num_rows):
                words = raw[offsets[i] : offsets[i + 1]].split()
                n_words.append(len(words))
                if not spans[i].is_valid:
                    kept.append(b" ".join(words))
                    n_removed.append(0)
                    removed.append([])
                    continue
                own = spans[i].values
                first = np.asarray(own.field("start"))
                depth = np.zeros(len(words) + 1, np.int32)
                np.add.at(depth, first, 1)
                np.add.at(depth, first + np.asarray(own.field("edges")) + k - 1, -1)
                gone = np.cumsum(depth[:-1]) > 0
                kept.append(b" ".join(compress(words, ~gone)))
                n_removed.append(int(gone.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])))).reshape(-1, 2)
                removed.append([{"start": int(a), "end": int(b)} for a, b in edge])
            yield pa.record_batch(
                [
                    block.column(block.schema.get_field_index("doc_id")),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                ["doc_id", "n_words", "n_removed", "kept", "removed"],
            )

    return run


def dedup_substrings(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, removed`` for each row of ``docs(doc_id, text)``.

    ``kept`` is the text of the remaining words, joined by one space; ``removed``
    lists the merged word spans [start, end) that went.
    """
    docs = docs.select("doc_id", "text")
    spans = repeated_spans(docs, k, m)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", *text_key())
    return (
        keyed.join(spans, ["k0", "k1"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_kept(k), f"doc_id {kind}, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>")
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
