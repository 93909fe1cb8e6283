"""Readers, writers and the stored form of archives."""
