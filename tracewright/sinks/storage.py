"""A run on disk: every table of every technique as Parquet, findings, and a manifest."""

from __future__ import annotations

import hashlib
import json
import re
import secrets
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frames import Frames
from ..registry import REGISTRY
from ..result import TechniqueResult

# Words that a column name of a stored table must not contain, and the longest stored string in bytes.
PRIVATE_WORDS = ("body", "content", "cwd", "excerpt", "filepath", "prompt", "raw", "snippet")
LONGEST = 500


class GuardError(ValueError):
    """A table that must not be stored."""


def check_columns(df: DataFrame) -> None:
    for name in df.columns:
        found = set(re.split(r"[^a-z0-9]+", name.lower())) & set(PRIVATE_WORDS)
        if found:
            raise GuardError(f"column {name!r} may hold private text ({', '.join(sorted(found))})")


def guarded(df: DataFrame) -> DataFrame:
    """``df`` whose strings fail the job where one is longer than ``LONGEST`` bytes."""
    check_columns(df)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            message = F.concat(F.lit(f"column {f.name} has a string of "), F.octet_length(c).cast("string"), F.lit(" bytes"))
            c = F.when(F.octet_length(c) > LONGEST, F.raise_error(message).cast("string")).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def infer_kind(values: list) -> str:
    """Type of a column of loose values: strings absorb all, booleans do not mix with numbers, floats absorb whole numbers."""
    kinds = {bool if isinstance(v, bool) else int if isinstance(v, int) else float if isinstance(v, float) else str for v in values if v is not None}
    if not kinds or str in kinds or (bool in kinds and len(kinds) > 1):
        return "string"
    return "boolean" if kinds == {bool} else "double" if float in kinds else "bigint"


def corpus_fingerprint(sessions: DataFrame) -> str:
    """SHA-256 over the sorted distinct paths, each followed by a newline; folded on the driver in order."""
    digest = hashlib.sha256()
    for row in sessions.select("source_path").where("source_path is not null").distinct().orderBy("source_path").toLocalIterator():
        digest.update(row.source_path.encode() + b"\n")
    return digest.hexdigest()


def freeze(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, size, sha256, tool`` of every log file."""
    from ..sources.logs import empty_files, roots_below, tool_of_path

    roots = [r for p in ([paths] if isinstance(paths, str) else paths) for r in roots_below(p)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(roots)
    path = F.regexp_replace("path", "^file:/+", "/")
    rows = files.select(path.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    none = spark.createDataFrame([(p, 0, hashlib.sha256(b"").hexdigest()) for p in empty_files(roots)], "path string, size bigint, sha256 string")
    return rows.unionByName(none).withColumn("tool", F.coalesce(tool_of_path(F.col("path")), F.lit("Unknown")))


def run_id() -> str:
    """Time-ordered unique id (version 7)."""
    ms, rand = int(time.time() * 1000), secrets.randbits(74)
    value = ms << 80 | 0x7 << 76 | (rand >> 62) << 64 | 0b10 << 62 | rand & (1 << 62) - 1
    h = f"{value:032x}"
    return f"run-{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


@dataclass
class Manifest:
    run_id: str
    corpus_fingerprint: str
    sessions: int
    strata: list[str] = field(default_factory=list)
    techniques: list[dict] = field(default_factory=list)

    @property
    def short_fingerprint(self) -> str:
        return self.corpus_fingerprint[:8]


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write through a temporary name, so that a reader sees all or nothing."""
    fs, target = _fs(spark, path)
    _, part = _fs(spark, path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def write_result(spark: SparkSession, folder: str, result: TechniqueResult) -> dict:
    """All tables and the findings of one technique; the guard fails before anything is written for bad names."""
    for df in result.tables.values():
        check_columns(df)
    tables = []
    for name, df in result.tables.items():
        path = f"{folder}/{slug(result.name)}/{slug(name)}.parquet"
        named = df.select(*(F.col(f"`{c}`").alias(slug(c)) for c in df.columns))
        guarded(named).write.mode("overwrite").parquet(path)
        tables.append({"name": name, "path": path, "primary": df is result.primary_table})
    if result.findings is not None:
        result.findings.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{slug(result.name)}/findings.parquet")
    return {"technique": result.name, "tables": tables}


def select_techniques(names: list[str] | None = None, essential: bool = False) -> tuple[list[str], list[str]]:
    """Chosen and unknown names: named ones, else the essential ones, else all."""
    if names:
        return [n for n in names if n in REGISTRY], [n for n in names if n not in REGISTRY]
    return [n for n, t in REGISTRY.items() if (t.essential or not essential) and n != "echo"], []


STRATA = ("Interactive", "Subagent", "Autonomous")


def analyze(frames: Frames, folder: str, names: list[str] | None = None, essential: bool = False, split: bool = False) -> tuple[Manifest, dict[str, str]]:
    """Run techniques, whole or by session type, and store what they return.

    A technique that fails is reported and does not stop the others; a table that
    must not be stored stops the run.  Sessions of unknown type are in no stratum.
    """
    spark = frames.sessions.sparkSession
    frames = frames.persist()
    n = frames.sessions.count()
    if not n:
        raise ValueError("the corpus has no sessions")
    chosen, unknown = select_techniques(names, essential)
    failed = {x: "unknown technique" for x in unknown}
    manifest = Manifest(run_id(), corpus_fingerprint(frames.sessions), n, list(STRATA) if split else [])
    base = f"{folder}/{manifest.run_id}"
    for stratum in STRATA if split else (None,):
        part = frames.stratum(stratum) if stratum else frames
        for name in chosen:
            try:
                done = write_result(spark, f"{base}/{stratum}" if stratum else base, REGISTRY[name].run(part))
            except GuardError:
                raise
            except Exception as e:  # noqa: BLE001 - one technique's failure is a row of the report
                failed[f"{stratum}/{name}" if stratum else name] = str(e).splitlines()[0]
                continue
            manifest.techniques.append(done | {"stratum": stratum})
    write_text(spark, f"{base}/manifest.json", json.dumps(asdict(manifest), indent=2))
    return manifest, failed


def latest_run(spark: SparkSession, folder: str) -> tuple[str, Manifest] | None:
    """The newest run that parses and is not stratified."""
    fs, path = _fs(spark, folder)
    names = sorted((s.getPath().getName() for s in fs.listStatus(path)), reverse=True) if fs.exists(path) else []
    for name in names:
        try:
            manifest = load_manifest(spark, f"{folder}/{name}")
        except Exception:  # noqa: BLE001 - a run that does not parse is passed over
            continue
        if not manifest.strata:
            return f"{folder}/{name}", manifest
    return None


def load_manifest(spark: SparkSession, run: str) -> Manifest:
    return Manifest(**json.loads(read_text(spark, f"{run}/manifest.json")))
