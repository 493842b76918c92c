"""Readers and writers of staged files."""
