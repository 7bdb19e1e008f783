"""Plans of rankloom."""
