"""An analytics engine on Spark: a DuckDB-flavoured SQL dialect, operators, sources and a table store."""
