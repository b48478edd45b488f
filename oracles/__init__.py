"""SQL statements for an independent engine, one per registered query."""
