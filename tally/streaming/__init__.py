"""Incremental execution of the cash-flow report with Structured Streaming."""
