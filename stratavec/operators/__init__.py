"""Operators over vectors (vec, pos, v)."""
