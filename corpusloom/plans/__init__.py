"""Whole queries: operators applied to tables, each with its DuckDB counterpart."""
