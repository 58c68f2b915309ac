"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; the registry of queries picks it
up only where it is present.
"""
