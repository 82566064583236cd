"""Traces: logs, fact tables and typed tables."""
