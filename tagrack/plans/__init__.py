"""Query registry, DuckDB oracle, broadcast checks, materialisation, plan inspection."""
