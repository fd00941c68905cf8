"""Plans: distributed ranks and exact quantiles, the dashboard bundles, the
registered queries and their DuckDB oracle SQL."""
