"""Operators for large-scale training-data pipelines (see ``registry`` for the queries)."""
