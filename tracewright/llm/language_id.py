"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1.  One binary classifier over hashed
byte trigrams predicts each bit; the loss-weighted decoder takes the language
whose codeword costs the least hinge loss, each bit weighted by how much better
than chance its classifier is when a row is left out.  Up to five languages have
the exhaustive code (all splits into two sides); more have the best of several
seeded random codes by least distance between codewords.  A text is flagged
ambiguous where the two nearest codewords cost about the same.

Training rows are a bounded sample: at most ``PER_LANGUAGE`` rows of each
language and ``SAMPLE`` in all, but at least one of every language, those with the
least hashes of their ids among the rows learned from, whole texts.  The fit runs
in one task, and the driver gets codes and weights.  Nothing but text is an input
of a prediction.  Texts are read in blocks; one very long text makes a block.

Nulls: a null text, or one without any letter, is ``und`` with score 0.  Rows
with null language or null id are never learned from; a null id counts as held
out.  Without any language to learn everything is ``und``; with a single one
every text with a letter is that.  Rows of one id and language take a place of
the sample each and enter it as one row, with the least text; repeated rows get
equal results.  Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .linear import Ridge, fit_in_one_task, fit_ridge, frequencies, pack, trigrams, unpack
from .textblocks import blocks

SAMPLE, PER_LANGUAGE = 1600, 400
PENALTY, AMBIGUOUS, SEED = 10.0, 0.1, 17


def code_matrix(n: int, seed: int = SEED) -> np.ndarray:
    """Codewords (n x bits) of n classes."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        # The first class is +1 in every bit; all other sides but the trivial one.
        sides = np.arange(1, 1 << (n - 1))
        rest = 1 - 2 * ((sides[None, :] >> np.arange(n - 1)[:, None]) & 1)
        return np.vstack([np.ones(len(sides), np.int64), rest]).astype(np.int8)
    bits = math.ceil(10 * math.log2(n))
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        agree = code.astype(np.int32) @ code.T
        near = ((bits - agree[np.triu_indices(n, 1)]) // 2).min()
        if near > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, near
    return best


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray
    bit_weight: np.ndarray
    model: Ridge | None

    def decode(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language, its share among all (0 to 1) and whether another is about as near."""
        loss = (np.maximum(0, 1 - score[:, None, :] * self.code[None]) * self.bit_weight).sum(axis=2)
        near = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        share = near / near.sum(axis=1, keepdims=True)
        first = loss.argmin(axis=1)
        second = np.sort(loss, axis=1)[:, 1] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return first, share[np.arange(len(first)), first], second - loss.min(axis=1) < AMBIGUOUS


def _features(batches):
    for block in blocks(batches):
        index, offsets = trigrams(block.column(1), lower=True)
        yield pa.record_batch([block.column(0), *pack(frequencies(index, offsets))], ["lang", "keys", "values"])


def learnable(docs: DataFrame):
    """Condition for rows to learn from: language known and not in the held-out quarter."""
    return docs["lang"].isNotNull() & docs["text"].isNotNull() & (held_out_bucket(docs) != 2)


def held_out_bucket(docs: DataFrame):
    return F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4


def _fit(rows: pa.Table) -> Codes:
    rows = sorted(rows.to_pylist(), key=lambda r: (r["lang"], r["keys"], r["values"]))
    languages = sorted({r["lang"] for r in rows})
    code = code_matrix(len(languages))
    if len(languages) < 2:
        return Codes(languages, code, np.ones(1), None)
    number = {x: i for i, x in enumerate(languages)}
    of = np.array([number[r["lang"]] for r in rows])
    weight = 1 / np.bincount(of)[of]
    sparse = unpack([r["keys"] for r in rows], [r["values"] for r in rows])
    target = code[of].astype(np.float64)
    model = fit_ridge(sparse, np.zeros((len(rows), 0)), target, weight, PENALTY)
    right = (weight @ (np.sign(model.left_out) == target)) / weight.sum()
    gain = np.maximum(2 * right - 1, 0.01)
    model.left_out = model.left_out[:0]
    return Codes(languages, code, gain / gain.mean() / len(gain) * code.shape[1] / 4, model)


def training_rows(docs: DataFrame, sample: int, per_language: int) -> DataFrame:
    """``lang, text`` of the sample.

    Ids are ranked without their texts, of which the chosen ones (at most
    ``sample``, or one a language) are fetched by a broadcast of their keys.
    """
    key = ["lang", "doc_id"]
    known = docs.where(learnable(docs)).select(*key, "text")
    languages = known.agg(F.count_distinct("lang")).first()[0]
    each = max(1, min(per_language, sample // max(1, languages)))
    place = F.md5(F.concat(F.lit("lang:"), F.col("doc_id").cast("string")))
    first = W.partitionBy("lang").orderBy("place", "doc_id")
    few = known.select(*key, place.alias("place")).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= each)
    return known.join(F.broadcast(few.select(*key).distinct()), key).groupBy(*key).agg(F.min("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, sample: int = SAMPLE, per_language: int = PER_LANGUAGE) -> Codes:
    rows = training_rows(docs, sample, per_language).mapInArrow(_features, "lang string, keys binary, values binary")
    return fit_in_one_task(rows, _fit) or Codes([], code_matrix(0), np.ones(1), None)


def _predict(shared):
    def run(batches):
        codes: Codes = shared.value
        for block in blocks(batches):
            text = block.column(1)
            letter = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            n = block.num_rows
            if codes.model is not None:
                index, offsets = trigrams(text, lower=True)
                first, share, close = codes.decode(codes.model.scores(index, offsets))
            else:
                first, share, close = np.zeros(n, np.int64), np.ones(n), np.zeros(n, bool)
                letter = letter & bool(codes.languages)
            name = np.array([*codes.languages, "und"], object)[np.where(letter, first, len(codes.languages))]
            yield pa.record_batch(
                [
                    block.column(0),
                    block.column(2),
                    pa.array(name, pa.string()),
                    pa.array(np.where(letter, np.round(np.clip(share, 0, 1), 4), 0.0)),
                    pa.array(letter & close),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return run


def identify(docs: DataFrame, codes: Codes) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` for each row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(codes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(held_out_bucket(docs) == 2, F.lit(True)).alias("held_out"))
    return rows.mapInArrow(_predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, train(docs))
