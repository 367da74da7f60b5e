"""Readers for raw logs, stored tables and side files."""
