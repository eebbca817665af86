"""Vectors from tables, text and binary files, and to them."""
