"""Readers and writers, the Python data source for changed files included."""
