"""Incremental reads and streams."""
