"""Incremental forms of the rollups."""
