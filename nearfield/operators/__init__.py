"""Operators over vectors (id, v) and graphs, as edges (src, pos, dst)."""
