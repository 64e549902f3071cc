"""Incremental arrival of panel files."""
