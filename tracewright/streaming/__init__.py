"""Structured Streaming form of the monitor."""
