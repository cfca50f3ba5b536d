"""Readers: session logs in four formats, trace tables, corpus manifests."""

from .logs import SOURCES, discover, read_logs

__all__ = ["SOURCES", "discover", "read_logs"]
