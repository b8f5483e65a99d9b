"""Operators on pages, index lines, wiki markup and templates."""
