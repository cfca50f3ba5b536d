"""Quality classification by hierarchical empirical Bayes.

* *Document evidence.*  A linear classifier over hashed byte trigrams and a few
  shape features (distinct words, repeated neighbours, capitals, symbols, word
  length, words) gives each document log odds of being good, calibrated on
  left-out scores of its training rows.
* *Hosts and paths.*  A host is a source; a path below it is a language within
  the source.  Grouped sums of the documents' probabilities give each host a beta
  posterior whose prior is the global mean, and each path one whose prior is its
  host's.  The prior strengths come from the spread between hosts, and between
  the paths of a host, beyond what sampling explains, so sparse sites shrink
  toward the level above.
* *Decision.*  A document's log odds move by those of its path against the global
  ones.  It is kept unless the resulting probability is below ``THRESHOLD``.

The classifier learns from a bounded sample: the ``SAMPLE`` labelled ids with the
least hashes, whole texts; an id with several labels or texts counts once, with
the least label and the text of the least hash.  It is fitted in one task, and
the driver gets the weights.  All statistics cover all documents, whose texts
are read once by Python, in blocks, so that a very long one bounds the memory.

Nulls: a null or empty text has no evidence of its own (log odds of the global
rate); a null source or language is a group of its own.  Without labels of both
kinds there is no evidence against anything and every row is kept.  Repeated rows
count as often as they occur and get equal results.  Columns of any name pass
through, but those named like a result are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .linear import Ridge, fit_in_one_task, fit_ridge, frequencies, pack, platt, trigrams, unpack
from .storage import if_small, materialize
from .textblocks import Words, blocks

SAMPLE, PENALTY, THRESHOLD = 2000, 10.0, 0.3
STRENGTH = (1.0, 1e4)
SHAPES = 7
SITE = ["h0", "h1", "p0", "p1"]  # host and path, each with whether it is null
_UPPER, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL[[ord(c) for c in "#*$%&|<>!{}[]=_~^\\@+"]] = True


def shapes(column: pa.Array) -> np.ndarray:
    """Shape features of each row (rows x SHAPES); zeros where there is no word."""
    words = Words(column)
    n = words.counts
    some = np.maximum(n, 1)
    hashes = words.hashes()
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, row))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=len(n))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    repeats = np.bincount(row[same], minlength=len(n))

    def share(table):
        total = np.append(0, np.cumsum(table[words.data]))
        return (total[words.rows[1:]] - total[words.rows[:-1]]) / np.maximum(np.diff(words.rows), 1)

    length = np.bincount(row, weights=words.ends - words.starts, minlength=len(n)) / some
    out = np.stack([distinct / np.sqrt(some), distinct / some, repeats / some, share(_UPPER), share(_SYMBOL), np.minimum(length, 40), np.log1p(n)], axis=1)
    return np.where((n > 0)[:, None], out, 0.0)


@dataclass
class Classifier:
    model: Ridge | None
    slope: float
    intercept: float
    base: float  # log odds of the labelled rate

    def log_odds(self, column: pa.Array) -> np.ndarray:
        if self.model is None:
            return np.full(len(column), self.base)
        index, offsets = trigrams(column)
        score = self.model.scores(index, offsets, shapes(column))[:, 0]
        odds = np.clip(self.slope * score + self.intercept, -12, 12)
        return np.where(np.diff(offsets) > 0, odds, self.base)


def _training_rows(batches):
    for block in blocks(batches):
        index, offsets = trigrams(block.column(1))
        dense = pa.array([x.tobytes() for x in shapes(block.column(1))], pa.binary())
        yield pa.record_batch([block.column(0), *pack(frequencies(index, offsets)), dense], ["good", "keys", "values", "dense"])


def _fit(rows: pa.Table) -> Classifier:
    rows = sorted(rows.to_pylist(), key=lambda r: (r["good"], r["keys"], r["values"]))
    good = np.array([r["good"] for r in rows], bool)
    if not good.any() or good.all():
        return Classifier(None, 0.0, 0.0, 12.0)
    weight = np.where(good, 1 / good.sum(), 1 / (~good).sum())
    dense = np.array([np.frombuffer(r["dense"]) for r in rows])
    sparse = unpack([r["keys"] for r in rows], [r["values"] for r in rows])
    model = fit_ridge(sparse, dense, np.where(good, 1.0, -1.0)[:, None], weight, PENALTY)
    slope, intercept = platt(model.left_out[:, 0], good)
    model.left_out = model.left_out[:0]
    return Classifier(model, slope, intercept, float(np.log(good.sum() / (~good).sum())))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Classifier of ``labels(doc_id, quality)``; the sample's ids (at most ``sample``) are broadcast."""
    place = F.md5(F.concat(F.lit("quality:"), F.col("doc_id").cast("string")))
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    chosen = chosen.orderBy(place, "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.first("good").alias("good"), F.min_by("text", F.md5("text")).alias("text")).select("good", "text")
    rows = rows.mapInArrow(_training_rows, "good boolean, keys binary, values binary, dense binary")
    return fit_in_one_task(rows, _fit) or Classifier(None, 0.0, 0.0, 12.0)


def with_evidence(docs: DataFrame, classifier: Classifier, host: str, path: str, carry: list[str]) -> DataFrame:
    """``row`` (a struct of the columns ``carry``, at least one), the site of each row and its log odds."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    rows = docs.select(F.struct(*carry).alias("row"), *_site(host, path), F.col("text").alias("text"))
    sent = [*rows.columns[:-1], "odds"]
    if "text" in carry:  # once only
        rows = rows.drop("text")
    at = carry.index("text") if "text" in carry else None

    def run(batches):
        for batch in batches:
            text = batch.column(0).field(at) if at is not None else batch.column(batch.num_columns - 1)
            parts = pa.record_batch([*batch.columns[: len(SITE) + 1], text], [*sent[:-1], "text"])
            for block in blocks([parts]):
                odds = shared.value.log_odds(block.column(len(SITE) + 1))
                yield pa.record_batch([*block.columns[: len(SITE) + 1], pa.array(np.round(odds, 6))], sent)

    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in sent[:-1]), StructField("odds", DoubleType())]))


def _site(host: str, path: str) -> list:
    parts = [(F.col(c).isNotNull(), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in (host, path)]
    return [x.alias(name) for name, x in zip(SITE, [x for pair in parts for x in pair], strict=True)]


def _strength(groups: DataFrame, mean: str):
    """Prior strength from between-group spread: groups have ``n, s, ss`` and the mean above them.

    Moments: the weighted squared deviations of group means exceed what sampling
    within groups gives by the between-group variance.
    """
    m = F.col("s") / F.col("n")
    row = groups.agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.count("*").alias("groups"),
        F.sum(F.col("n") * (m - F.col(mean)) ** 2).alias("between"),
        F.sum(F.col("ss") - F.col("n") * m * m).alias("within"),
        F.avg(F.col(mean) * (1 - F.col(mean))).alias("spread"),
    ).first()
    if not row.groups or row.groups < 2 or row.rows <= row.groups:
        return STRENGTH[1]
    inside = max(0.0, row.within) / (row.rows - row.groups)
    free = row.rows - row.squares / row.rows
    variance = (row.between - (row.groups - 1) * inside) / free if free > 0 else 0.0
    return float(np.clip(row.spread / variance - 1, *STRENGTH)) if variance > 0 else STRENGTH[1]


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """Posterior mean of each path (``h0, h1, p0, p1, site, host``) of rows with ``odds``, and the global mean."""
    p = 1 / (1 + F.exp(-F.col("odds")))
    key = SITE[:2]
    paths = scored.select(*SITE, p.alias("p")).groupBy(*SITE).agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss"))
    paths = materialize(paths, "quality-paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = total.s / total.n if total.n else 0.5
    hosts = paths.groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss"))).withColumn("above", F.lit(mean))
    strength = _strength(hosts, "above")
    hosts = hosts.select(*key, ((strength * mean + F.col("s")) / (strength + F.col("n"))).alias("host"))
    below = paths.join(hosts, key)
    strength = _strength(below, "host")
    return below.select(*SITE, ((strength * F.col("host") + F.col("s")) / (strength + F.col("n"))).alias("site"), "host"), mean


RESULTS = ("evidence", "host_prior", "site_prior", "quality_score", "kept")


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``evidence``, ``host_prior``, ``site_prior``, ``quality_score`` and ``kept``."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULTS]
    scored = materialize(with_evidence(docs, train(docs, labels), host, path, carry), "quality-evidence")
    sites, mean = site_posteriors(scored)
    sites = materialize(sites, "quality-sites")
    full = scored.join(if_small(sites), SITE)
    logit = lambda x: F.log(x / (1 - x))
    inside = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.col("odds") + logit(inside(F.col("site"))) - logit(inside(F.lit(float(mean))))
    score = 1 / (1 + F.exp(-odds))
    results = (F.col("odds"), F.col("host"), F.col("site"), score, score >= threshold)
    return full.select(*(F.col("row")[c].alias(c) for c in carry), *(x.alias(name) for x, name in zip(results, RESULTS, strict=True)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, carry=["doc_id"]).select("doc_id", "kept", *(F.round(c, 5).alias(c) for c in RESULTS[:-1]))
