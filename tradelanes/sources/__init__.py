"""Scans, sinks and resumable ingestion."""
