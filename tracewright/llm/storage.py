"""Intermediate tables; see ``operators/storage.py``."""

from ..operators.storage import CLEANUP, SMALL_ROWS, drop, if_small, materialize, shared_dir

__all__ = ["CLEANUP", "SMALL_ROWS", "drop", "if_small", "materialize", "shared_dir"]
