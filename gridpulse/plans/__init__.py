"""Plans: dashboard queries, the query registry and the full-refresh pipeline."""
