"""Sources of rankloom."""
