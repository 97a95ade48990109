"""Incremental reads, streams and schedules."""
