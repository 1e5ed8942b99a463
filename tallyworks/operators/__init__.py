"""Operators with state or policy around a plan: privacy, history, queue, semantic model, similarity."""
