"""Operators on whole tables and arrays."""
