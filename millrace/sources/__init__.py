"""Sources, sinks, tables and materialized views."""
