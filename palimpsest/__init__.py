"""Versioned triples and analytics on Spark."""
