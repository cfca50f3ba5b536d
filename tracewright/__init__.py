"""Agent-session analytics on Spark."""
