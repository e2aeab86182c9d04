"""Queries over the parquet tables, and the SQL each is checked with."""
