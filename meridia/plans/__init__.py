"""Queries: operators applied to tables, with their SQL."""
