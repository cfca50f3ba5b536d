"""What a technique returns: findings and typed tables, all lazy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import Frames

FINDINGS = "technique string, label string, value_json string, description string"


@dataclass
class TechniqueResult:
    name: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    findings: DataFrame | None = None
    primary: str | None = None  # the one table that earlier storage formats kept

    @property
    def primary_table(self) -> DataFrame | None:
        name = self.primary or next(iter(self.tables), None)
        return self.tables[name] if name else None


def json_value(value: Column) -> Column:
    """A number, string, boolean or struct as JSON text; NaN and infinities as null."""
    wrapped = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    text = F.regexp_extract(wrapped, r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(text.isin('"NaN"', '"Infinity"', '"-Infinity"'), "null").otherwise(text)


def findings_of(technique: str, row: DataFrame, described: dict[str, str] | None = None) -> DataFrame:
    """Findings from a one-row frame: one for each column."""
    described = described or {}
    pairs = [F.struct(F.lit(c).alias("label"), json_value(F.col(f"`{c}`")).alias("value_json"), F.lit(described.get(c)).cast("string").alias("description")) for c in row.columns]
    return row.select(F.lit(technique).alias("technique"), F.inline(F.array(*pairs)))


def findings_from_rows(technique: str, rows: DataFrame, label: Column, value: Column) -> DataFrame:
    """Findings with one row of ``rows`` each."""
    return rows.select(F.lit(technique).alias("technique"), label.alias("label"), json_value(value).alias("value_json"), F.lit(None).cast("string").alias("description"))


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@dataclass(frozen=True)
class Technique:
    name: str
    essential: bool
    needs: tuple[str, ...]
    run: Callable[[Frames], TechniqueResult]
    description: str


REGISTRY: dict[str, Technique] = {}


def technique(name: str, essential: bool = False, needs: tuple[str, ...] = ("tool_calls",)):
    """Register a function ``(Frames) -> TechniqueResult`` under its public name."""

    def add(f):
        REGISTRY[name] = Technique(name, essential, needs, f, (f.__doc__ or "").strip().split("\n")[0])
        return f

    return add
