"""End-to-end pipelines, test tables, the query catalogue and its SQL checks."""
