"""Streaming of rankloom."""
