"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; the entry point adds its queries
only when the subpackage can be imported.
"""
