"""Structured Streaming pipeline over growing log files."""
