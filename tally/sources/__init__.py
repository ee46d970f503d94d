"""Sources: driver tables, derived fixtures, ingest/coercion, HTML extraction."""
