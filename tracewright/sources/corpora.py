"""Pinned public corpora: a registry, file selection and table adapters."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIERS = ("smoke", "representative", "full")
# Files and folders of a corpus that are not logs.
NOT_LOGS = ("metadata", "manifest", "index", "dataset_info", "state")
NOT_FOLDERS = ("indexes", ".cache")


@dataclass(frozen=True)
class Corpus:
    name: str
    repo: str
    revision: str
    tier: str
    format: str = "jsonl"


def load_registry(text: str) -> list[Corpus]:
    """Corpora of a JSON registry; one without repository, pinned revision or known tier fails the whole."""
    out = []
    for item in json.loads(text)["corpora"]:
        missing = [k for k in ("name", "repo", "revision", "tier") if not item.get(k)]
        if missing:
            raise ValueError(f"corpus {item.get('name')!r} lacks {', '.join(missing)}")
        if item["tier"] not in TIERS:
            raise ValueError(f"corpus {item['name']!r} has unknown tier {item['tier']!r}")
        if len(item["revision"]) != 40 or set(item["revision"]) - set("0123456789abcdef"):
            raise ValueError(f"corpus {item['name']!r} is not pinned to a commit")
        out.append(Corpus(**{k: item[k] for k in ("name", "repo", "revision", "tier", "format") if k in item}))
    return out


def select_corpora(corpora: list[Corpus], tier: str | None = None, names: list[str] | None = None) -> list[Corpus]:
    """Corpora of a tier or by name; an unknown name or an empty selection fails."""
    if names and (unknown := set(names) - {c.name for c in corpora}):
        raise ValueError(f"unknown corpora: {', '.join(sorted(unknown))}")
    chosen = [c for c in corpora if (not tier or c.tier == tier) and (not names or c.name in names)]
    if not chosen:
        raise ValueError("no corpus selected")
    return chosen


def log_files(files: DataFrame) -> DataFrame:
    """``path, content`` without metadata files and index or cache folders."""
    stem = F.lower(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1))
    inside = F.col("path").rlike("/(" + "|".join(x.replace(".", r"\.") for x in NOT_FOLDERS) + ")/")
    return files.where(~stem.isin(*NOT_LOGS) & ~inside)


def stable_hash(value: str, prefix: str = "id") -> str:
    return f"{prefix}_{hashlib.sha256(value.encode()).hexdigest()[:12]}"


def stable_hashes(column: str, prefix: str):
    """:func:`stable_hash` as a column; null stays null."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(column, 256), 1, 12))


def chat_sessions(sessions: DataFrame, repos: DataFrame) -> DataFrame:
    """Session metadata with its repository's; names hashed."""
    rows = sessions.join(repos, "repo_id", "left")
    path = F.concat(F.lit("transcripts/"), "session_id", F.lit(".jsonl"))
    return rows.select("session_id", stable_hashes("repo_id", "repo").alias("repo"), F.coalesce(stable_hashes("user_id", "user"), F.lit("missing_user")).alias("user"), "agent", "created_at", "repo_type_domain", "repo_type_audience", "license_type", F.when(F.trim("session_id") != "", path).alias("transcript"))


def chat_tables(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`chat_sessions` of a folder's tables, columns pruned at the scan."""
    sessions = spark.read.parquet(f"{folder}/sessions.parquet").select("session_id", "repo_id", "user_id", "agent", "created_at")
    repos = spark.read.parquet(f"{folder}/repositories.parquet").select("repo_id", "repo_type_domain", "repo_type_audience", "license_type")
    return chat_sessions(sessions, repos)
