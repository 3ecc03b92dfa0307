"""Structured Streaming form of the monitoring plans."""
