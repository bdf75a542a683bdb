"""Composed plans: the registered queries, their DuckDB oracle SQL, the chained dataset
build and a developer check that compares the two engines."""
