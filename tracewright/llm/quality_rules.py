"""Quality rules and a hashed n-gram likelihood ratio, with DataFrame functions only.

* *Base rules* count characters in words, symbols, repeated lines and words in
  repeated windows of three; a text fails with fewer than ``MIN_WORDS`` words or
  with more than half of its words in repeated windows.
* *Likelihood ratio.*  Lower-cased words and word pairs are hashed into
  ``BUCKETS`` buckets.  Two smoothed multinomials over the buckets, one of trusted
  texts and one of the whole corpus, give every bucket a log ratio.  A text's
  score is the mean ratio of its n-grams, and it is kept from ``THRESHOLD`` on.

Repeated windows are found by sorting the hashes of one text with their places,
so a text costs n log n however repetitive it is.  The corpus counts are partial
sums over at most ``BUCKETS`` keys a task, whatever words are frequent; nothing
else is shuffled.  The ratios (``BUCKETS`` numbers) enter the plan as a literal.

Trusted texts are those of at most ``TRUSTED`` good labels (quality 1, not toxic)
with the least hashes of their ids; the corpus model covers all documents.

Nulls: a null or empty text has no words and fails the base rules.  A text whose
n-grams tell nothing has score 0.  Without trusted texts all ratios are those of
the corpus against a uniform model, shifted out: every score is 0.  Repeated rows
count as often as they occur; null ids are never trusted.  Columns of any name
pass through, but those named like a result are replaced by it.  A very long text
is one row's arrays of eight bytes a word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD, SPACES, SYMBOLS = r"[^\x20\x09-\x0D]+", " \t\n\u000b\f\r", "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50
BUCKETS, SMOOTHING, THRESHOLD, TRUSTED = 1 << 14, 1.0, -0.08, 5000
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def _length(column, without: str):
    return F.length(F.translate(column, without, ""))


def _after(column: str, k: int):
    """The array without its first ``k`` elements."""
    return F.slice(column, k + 1, F.greatest(F.size(column) - k, F.lit(0)))


def _pairs(hashes: str):
    """Hashes of neighbours in an array of hashes; zip_with pads, so one of the two is cut."""
    first = F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0)))
    return F.zip_with(first, _after(hashes, 1), lambda x, y: F.xxhash64(x, y))


def _hashes(text):
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 0)
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(hashes: str, pairs):
    """Hashes of three neighbours, from the hashes of one and two."""
    first = F.slice(pairs, 1, F.greatest(F.size(hashes) - 2, F.lit(0)))
    return F.zip_with(first, _after(hashes, 2), lambda x, y: F.xxhash64(x, y))


def _repeats(windows: str):
    return F.size(F.array_distinct(windows)) < F.size(windows)


def _measured(docs: DataFrame) -> DataFrame:
    """``row`` (the other columns of ``docs``), the base columns, and ``hashes`` of lower-cased words and ``pairs`` of them.

    Each word is hashed once as a string; everything longer is hashed from that.
    Only texts whose lower-cased windows repeat are hashed case by case and sorted.
    """
    rows = docs.select(F.struct(*(c for c in docs.columns if c not in RESULTS)).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("hashes", _hashes(F.lower("text"))).withColumn("pairs", _pairs("hashes"))
    rows = rows.withColumn("windows", _windows("hashes", F.col("pairs")))
    rows = rows.withColumn("exact", F.when(_repeats("windows"), _hashes(F.col("text"))))
    rows = rows.withColumn("windows", F.when(F.col("exact").isNotNull(), _windows("exact", _pairs("exact"))))
    rows = rows.withColumn("order", F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    hash_at = lambda j: F.get("order", j)["h"]
    again = F.filter(
        F.transform("order", lambda x, j: F.when(x["h"].eqNullSafe(hash_at(j - 1)) | x["h"].eqNullSafe(hash_at(j + 1)), x["i"])),
        lambda i: i.isNotNull(),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))
    rows = rows.withColumns(
        {
            "n_words": F.size("hashes").cast("long"),
            "word_chars": _length(F.col("text"), SPACES).cast("long"),
            "n_symbols": (F.length("text") - _length(F.col("text"), SYMBOLS)).cast("long"),
            "lines": F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)),
            "n_repeat_words": F.coalesce(F.when(F.col("order").isNotNull(), covered), F.lit(0)).cast("long"),
        }
    )
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.select("row", "hashes", "pairs", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def base_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with the base columns; names of results in ``docs`` are dropped."""
    return _measured(docs).select("row.*", *RESULTS[:6])


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` over all lower-cased words and word pairs of ``docs(text)``."""
    rows = docs.select(_hashes(F.lower("text")).alias("hashes")).where("hashes is not null")
    rows = rows.select(F.explode(F.concat("hashes", _pairs("hashes"))).alias("h"))
    return rows.groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def trusted_texts(docs: DataFrame, labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    good = labels.where("doc_id is not null and quality = 1" + (" and coalesce(toxic, 0) = 0" if "toxic" in labels.columns else ""))
    ids = good.select("doc_id").distinct().orderBy(F.md5(F.concat(F.lit("trust:"), F.col("doc_id").cast("string"))), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")  # at most ``most`` ids


def log_ratios(trusted: DataFrame, corpus: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row: ``ratios``, an array with the log ratio of every bucket."""
    every = trusted.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    t = bucket_counts(trusted, buckets).withColumnRenamed("n", "t")
    r = bucket_counts(corpus, buckets).withColumnRenamed("n", "r")
    both = every.join(t, "bucket", "left").join(r, "bucket", "left").select("bucket", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("r", F.lit(0)).alias("r"))
    one = both.agg(F.sum("t").alias("ts"), F.sum("r").alias("rs"), F.array_sort(F.collect_list(F.struct("bucket", "t", "r"))).alias("all"))
    share = lambda n, total: F.log((n + smoothing) / (total + smoothing * buckets))
    ratio = F.transform("all", lambda x: F.when(F.col("ts") > 0, F.round(share(x["t"], F.col("ts")) - share(x["r"], F.col("rs")), 6)).otherwise(0.0))
    return one.select(ratio.alias("ratios"))


def judge(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base columns, ``score`` and ``kept``; the corpus model is that of ``docs``."""
    found = log_ratios(trusted, docs, buckets).first().ratios  # ``buckets`` numbers
    ratios = F.split(F.lit(",".join(map(repr, found))), ",").cast("array<double>")  # folded into one literal
    rows = _measured(docs).withColumn("grams", F.concat("hashes", "pairs"))
    total = F.aggregate("grams", F.lit(0.0), lambda acc, h: acc + F.get(ratios, F.pmod(h, F.lit(buckets)).cast("int")))
    rows = rows.withColumn("score", F.round(total / F.greatest(F.size("grams"), F.lit(1)), 6))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return rows.select("row.*", *RESULTS)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, trusted_texts(docs, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
