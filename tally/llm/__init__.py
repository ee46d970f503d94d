"""Operators of a training-data pipeline, each on plain DataFrames.

Nothing outside this subpackage imports it.  ``tally.llm.registry`` holds its
registered queries and their SQL.
"""
