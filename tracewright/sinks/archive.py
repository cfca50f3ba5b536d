"""Content-addressed archive of raw logs as a Spark job.

Objects are stored once by SHA-256; an observation records that a path had that
content.  The tables of objects and observations are the manifest.
"""

from __future__ import annotations

import hashlib
import os
import warnings
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.logs import DISPLAY, empty_files, get, read_lines, roots_below, timestamp, tool_of_path

OBSERVATIONS = "observation_id string, path string, canonical_path string, tool string, sha256 string, size bigint, mtime timestamp"


EMPTY = hashlib.sha256(b"").hexdigest()


class ArchiveError(ValueError):
    pass


def check_overlap(sources: list[str], archive: str) -> None:
    """An archive must not equal, contain or lie inside a source, neither as written nor resolved."""
    for source in sources:
        for resolve in (os.path.abspath, os.path.realpath):
            a, b = resolve(source), resolve(archive)
            if os.path.commonpath([a, b]) in (a, b):
                raise ArchiveError(f"archive {archive} overlaps source {source}")


def candidates(spark: SparkSession, roots: list[str], required: bool = True) -> DataFrame:
    """``path, canonical_path, tool, sha256, size, mtime``; a missing root fails if the caller named it."""
    missing = [r for r in roots if "://" not in r and not os.path.exists(r)]
    if missing and required:
        raise ArchiveError(f"no such folder: {', '.join(missing)}")
    there = [x for r in roots if r not in missing for x in roots_below(r)]
    if not there:
        return spark.createDataFrame([], "path string, canonical_path string, tool string, sha256 string, size bigint, mtime timestamp, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(there)
    files = files.select("path", "length", F.col("modificationTime").alias("mtime"), "content")
    none = [(p, 0, datetime.fromtimestamp(os.path.getmtime(p), UTC), bytearray()) for p in empty_files(there)]
    files = files.unionByName(spark.createDataFrame(none, "path string, length bigint, mtime timestamp, content binary"))
    path = F.regexp_replace("path", "^file:/+", "/")
    real = F.udf(os.path.realpath) if all("://" not in r for r in there) else lambda c: c
    tool = F.coalesce(tool_of_path(path), F.lit("Unknown"))
    return files.select(path.alias("path"), real(path).alias("canonical_path"), tool.alias("tool"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "mtime", "content").dropDuplicates(["path"])


def observation_id():
    return F.sha2(F.concat_ws("\u0000", F.col("path"), F.coalesce("canonical_path", F.lit("")), F.col("tool"), F.col("sha256")), 256)


def plan(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` with ``observation_id`` and ``action``: copy, dedupe, or known.

    Of new files with the same content the first by tool and path is copied.
    """
    rows = found.withColumn("observation_id", observation_id())
    old_objects = known.select("sha256").distinct().withColumn("stored", F.lit(True))
    old_rows = known.select("observation_id").distinct().withColumn("seen", F.lit(True))
    nth = F.row_number().over(W.partitionBy("sha256").orderBy("tool", "path"))
    rows = rows.join(old_objects, "sha256", "left").join(old_rows, "observation_id", "left").withColumn("nth", nth)
    action = F.when(F.col("seen"), "known").when(F.col("stored") | (F.col("nth") > 1), "dedupe").otherwise("copy")
    return rows.withColumn("action", action).drop("stored", "seen", "nth")


def summary(planned: DataFrame) -> DataFrame:
    return planned.groupBy("tool", "action").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def object_path(archive: str, digest: str) -> str:
    return f"{archive}/objects/{digest[:2]}/{digest}"


def enrich(files: DataFrame) -> DataFrame:
    """Parse status, session ids, first and last time and first bad line of ``path, content``."""
    text = files.select("path", F.decode("content", "UTF-8").alias("content"))
    raw = text.select("path", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line")).where("trim(line) <> ''")
    good = read_lines(text)
    facts = good.groupBy("path").agg(
        F.min(timestamp(get("v", "$.timestamp"))).alias("first_ts"), F.max(timestamp(get("v", "$.timestamp"))).alias("last_ts"),
        F.array_sort(F.collect_set(F.coalesce(get("v", "$.sessionId"), get("v", "$.payload.id"), F.when(get("v", "$.type") == "session", get("v", "$.id"))))).alias("session_ids"),
        F.count("*").alias("lines"),
    )
    bad = raw.where(F.try_parse_json("line").isNull()).groupBy("path").agg(F.min("line_no").alias("first_bad_line"))
    rows = text.select("path", (F.trim("content") == "").alias("empty")).join(facts, "path", "left").join(bad, "path", "left")
    status = F.when(F.col("empty"), "empty_placeholder").when(F.col("lines").isNull(), "unparseable").when(F.col("first_bad_line").isNotNull(), "parser_error").otherwise("parsed")
    return rows.select("path", status.alias("status"), "session_ids", "first_ts", "last_ts", "first_bad_line")


def known_observations(spark: SparkSession, archive: str) -> DataFrame:
    path = f"{archive}/observations"
    return spark.read.parquet(path) if os.path.isdir(path) else spark.createDataFrame([], OBSERVATIONS)


def keep_out_of_git(target: str) -> bool:
    """Let a work tree of git that holds the archive ignore it; whether it is ignored after that.

    An ignore file that is there already is left as it is.
    """
    above = os.path.realpath(target)
    while not os.path.exists(os.path.join(above, ".git")):
        if above == os.path.dirname(above):
            return True
        above = os.path.dirname(above)
    rules = os.path.join(target, ".gitignore")
    if not os.path.exists(rules):
        with open(rules, "w") as f:
            f.write("*\n!.gitignore\n")
    with open(rules) as f:
        return any(line.strip() == "*" for line in f)


def archive(spark: SparkSession, roots: list[str], target: str, dry_run: bool = False, consent: bool = False, required: bool = True) -> DataFrame:
    """Copy new contents and append new observations; returns the summary.

    Workers write objects under their digest through a temporary name, so a
    repeated or lost task leaves the same files.  The target is a shared folder.
    """
    check_overlap(roots, target)
    known = known_observations(spark, target)
    planned = plan(candidates(spark, roots, required), known)
    if dry_run:
        return summary(planned)
    if not consent:
        raise ArchiveError("archiving needs consent")
    lock = os.path.join(target, ".lock")
    os.makedirs(target, exist_ok=True)
    try:
        os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
    except FileExistsError as e:
        raise ArchiveError(f"another run holds {lock}") from e
    try:
        if not keep_out_of_git(target):
            warnings.warn(f"{target}/.gitignore does not ignore everything: archived logs could be committed", stacklevel=2)
        planned = planned.persist()

        def store(rows):
            for r in rows:
                path = object_path(target, r.sha256)
                if os.path.exists(path):
                    if os.path.getsize(path) != r.size:
                        raise ArchiveError(f"object {r.sha256} has another size")
                    continue
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(r.content)
                os.replace(part, path)

        planned.where("action = 'copy'").select("sha256", "size", "content").foreachPartition(store)
        report = spark.createDataFrame(summary(planned).collect(), "tool string, action string, files bigint, bytes bigint")
        planned.where("action <> 'known'").select("observation_id", "path", "canonical_path", "tool", "sha256", "size", "mtime").write.mode("append").parquet(f"{target}/observations")
        planned.unpersist()
        return report
    finally:
        os.remove(lock)


def drift(spark: SparkSession, target: str) -> DataFrame:
    """Objects that are missing or whose content is not that of their name (an empty one has nothing to lose)."""
    known = known_observations(spark, target).select("sha256").where(F.col("sha256") != EMPTY).distinct()
    if not os.path.isdir(f"{target}/objects"):
        return known.withColumn("problem", F.lit("missing"))
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{target}/objects").select(F.regexp_extract("path", "([^/]*)$", 1).alias("sha256"), F.sha2("content", 256).alias("now"))
    rows = known.join(stored, "sha256", "left")
    return rows.select("sha256", F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed").alias("problem")).where("problem is not null")


def session_index(spark: SparkSession, target: str) -> DataFrame:
    """Observations with what parsing their objects gives: the derived index."""
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{target}/objects")
    facts = enrich(stored.select(F.regexp_extract("path", "([^/]*)$", 1).alias("path"), "content")).withColumnRenamed("path", "sha256")
    shown = F.create_map(*(F.lit(x) for pair in DISPLAY.items() for x in pair))
    rows = known_observations(spark, target).join(facts, "sha256", "left").withColumn("status", F.when(F.col("sha256") == EMPTY, "empty_placeholder").otherwise(F.col("status")))
    return rows.withColumn("tool_name", F.coalesce(F.try_element_at(shown, F.col("tool")), F.col("tool")))
