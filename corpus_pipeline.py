"""A training corpus from raw documents in five stages.

Every stage takes all rows the one before it kept, as reread from Parquet, and
returns the columns of ``documents``; the last returns token ids.

1. *quality*: documents that the quality classifier rejects go.
2. *lines*: repeated three-line windows lose their later occurrences.
3. *near duplicates*: one document of each group of near copies stays.
4. *mix*: sources are repeated or cut to their target weights.
5. *encode*: whole texts become SentencePiece ids, checked by decoding.

No stage of it as a whole can be expressed in SQL (trained models, signatures),
so there is no ``ORACLE_SQL``; tests compare the run with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import line_dedup, mixing, near_dedup, piece_codec, quality
from tracewright.llm.storage import materialize

ORACLE_SQL = None


def _as_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` of the text as it is now."""
    return rows.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _as_documents(quality.classify(docs, labels).where("kept"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(line_dedup.dedup_lines(docs), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles and similarity 0.8, as for all stages on word shingles."""
    return _as_documents(near_dedup.one_of_each(docs, width=5), docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(mixing.mixed_rows(docs), docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode_decode(docs, piece_codec.default_model())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing to target weights", mix_stage),
    ("SentencePiece encoding", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
