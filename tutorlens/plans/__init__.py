"""Composed analyses, the query registry and the SQL oracles."""
