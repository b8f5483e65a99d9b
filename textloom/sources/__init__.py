"""Dumps, their indexes and catalogs as DataFrames; sinks."""
