"""Plans: the report spec, the named query registry and its SQL oracle."""
