"""Queries over the Parquet tables, each with its SQL twin."""
