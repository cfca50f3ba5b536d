"""Sinks: guarded Parquet runs with a manifest, and renderers of small results."""
