"""Composite queries built from several operators."""
