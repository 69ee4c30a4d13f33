"""Relational operators of the read search."""
