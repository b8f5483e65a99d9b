"""Corpora made of tables, and the registered queries."""
