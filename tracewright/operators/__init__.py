"""Reusable operators: ordered sequences, prefix sums, runs."""
