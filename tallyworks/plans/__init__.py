"""Logical plans: marts over the source tables, and the named queries over the marts."""
