"""Streams from CSV files and tables, and the sinks of results."""
