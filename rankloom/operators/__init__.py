"""Operators of rankloom."""
