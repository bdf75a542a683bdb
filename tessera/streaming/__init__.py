"""Incremental application of the row-wise stages to newly arriving files (Structured
Streaming with an availableNow trigger)."""
