"""Functions of rankloom."""
