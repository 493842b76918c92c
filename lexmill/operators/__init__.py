"""Relational operators over statute tables."""
