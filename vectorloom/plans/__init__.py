"""Named queries and their DuckDB oracles."""
