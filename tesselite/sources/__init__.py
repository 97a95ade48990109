"""Readers of formats that Spark doesn't read by itself or reads by other rules."""
