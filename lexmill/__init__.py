"""Statute search, cross-reference analytics and corpus preparation on Spark."""
