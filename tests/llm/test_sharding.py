import hashlib
import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm.sharding import hilbert_index, hilbert_shards, query, write_shards


def test_curve_visits_every_cell_by_unit_steps():
    for n, bits in ((2, 3), (3, 2), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n))).T
        index = hilbert_index(list(cells), bits)
        assert sorted(index) == list(range(1 << n * bits))
        path = cells[:, np.argsort(index)]
        assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def laws(rows, shards, texts):
    groups = defaultdict(list)
    for r in rows:
        groups[r.shard].append(r)
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s in range(shards):
        assert sorted(r.slot for r in groups[s]) == list(range(len(groups[s])))
        assert abs(sum(r["size"] for r in groups[s]) - total / shards) <= most
    order = [r.hilbert for s in range(shards) for r in sorted(groups[s], key=lambda r: r.slot)]
    assert order == sorted(order)
    got = sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=repr)
    assert got == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts), key=repr)


def test_query(spark, sf_dir):
    rows = query(spark, sf_dir).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    laws(rows, 16, texts)


def test_odd_rows(docs, corpus, empty):
    clash = docs.withColumns({"key": F.lit(1), "shard": F.lit("x"), "size": F.lit(None).cast("int"), "low": F.lit(3)})
    rows = hilbert_shards(clash, 4).collect()
    laws(rows, 4, [(r[0], r[1]) for r in corpus])
    again = hilbert_shards(docs.repartition(5), 4).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    assert hilbert_shards(empty).collect() == []


def brute(rows, shards, bits=8):
    """The assignment from one sorted list."""
    tail = 62 - 3 * bits
    n = len(rows)

    def place(column):
        values = sorted((r[column] is not None, r[column] or "") for r in rows)
        return {v: sum(1 for x in values if x < v) * (1 << bits) // n for v in set(values)}

    places = {c: place(c) for c in ("source", "lang")}
    keyed = []
    for r in rows:
        text = (r["text"] or "").encode()
        at = [places[c][r[c] is not None, r[c] or ""] for c in ("source", "lang")]
        at.append(min(int(math.log2(len(text) + 1) * (1 << bits) / 32), (1 << bits) - 1))
        index = int(hilbert_index([np.array([x]) for x in at], bits)[0])
        low = int(hashlib.md5(("null" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16) >> (60 - tail)
        keyed.append((index << tail | low, r["doc_id"], zlib.crc32(text), len(text) + 1))
    keyed.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2], x[3]))
    total, done, slots, out = sum(x[3] for x in keyed), 0, Counter(), []
    for _, doc, crc, size in keyed:
        shard = min(shards - 1, (2 * done + size) * shards // (2 * total))
        out.append((doc, size, crc, shard, slots[shard]))
        slots[shard] += 1
        done += size
    return sorted(out, key=repr)


def test_assignment_equals_brute_force(spark, docs, sf_dir):
    for table, shards in ((spark.read.parquet(f"{sf_dir}/documents.parquet"), 16), (docs, 4)):
        got = hilbert_shards(table, shards).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
        assert sorted(map(tuple, got), key=repr) == brute([r.asDict() for r in table.collect()], shards)


def test_files(docs, spark, tmp_path):
    write_shards(docs.withColumns({"row": F.lit("x"), "slot": F.lit(1)}), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*docs.columns, "row", "slot", "shard"}
    want = Counter((r.doc_id, r.shard) for r in hilbert_shards(docs, 4).collect())
    assert Counter((r.doc_id, r.shard) for r in back.collect()) == want
    assert sorted(map(repr, back.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))


def test_very_long_text(spark):
    rows = [(i, "x" * (2_000_000 if i == 7 else 10 + i), "s", "en") for i in range(40)]
    got = hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), 4).collect()
    laws(got, 4, [(r[0], r[1]) for r in rows])
