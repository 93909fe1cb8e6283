"""Choices that are made before a plan is built."""
