"""Operators: filters and the report plans built on one aggregation each."""
