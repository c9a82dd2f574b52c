"""Plan-level helpers: lineage cuts, shipping Python code, the query catalogue."""
