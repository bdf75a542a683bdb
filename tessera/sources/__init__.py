"""Inputs and outputs: parquet tables, graph snapshots, stage tables and training files,
and the fixtures derived from the driver tables."""
