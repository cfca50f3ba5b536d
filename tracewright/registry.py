"""All techniques, loaded."""

from __future__ import annotations

from .plans import behaviour, corpus, numeric, process, sequence, trends
from .result import REGISTRY, Technique

MODULES = (sequence, behaviour, numeric, trends, process, corpus)

__all__ = ["MODULES", "REGISTRY", "Technique"]
