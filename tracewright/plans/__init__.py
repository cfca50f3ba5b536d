"""Techniques as declarative plans over the canonical frames."""
