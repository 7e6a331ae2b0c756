"""Operators for large training-data pipelines. Nothing outside this subpackage imports it."""
