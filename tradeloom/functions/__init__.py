"""Part of tradeloom."""
