"""Relational, time-series, retrieval and graph operators."""
