"""Incremental ingestion, and windowed aggregates over event streams (an extension: nothing else here needs streams)."""
