"""The engine's questions over the harness tables, and the same in DuckDB's SQL."""
