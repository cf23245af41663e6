"""Streaming of the core engine."""
