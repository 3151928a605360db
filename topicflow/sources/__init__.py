"""Readers, writers and the storage layout of the tables."""
