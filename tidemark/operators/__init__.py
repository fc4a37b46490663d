"""Operators on entry logs."""
