"""Versions from streams."""
