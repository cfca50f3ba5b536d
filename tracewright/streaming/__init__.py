"""Streaming forms, beyond the batch operators: incremental observation, session windows, online control charts."""
