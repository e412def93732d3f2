"""Scans, sinks and per-file jobs."""
