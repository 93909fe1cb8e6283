"""Operators over snapshots and change logs."""
