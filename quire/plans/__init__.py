"""Operators composed into the registered queries and whole jobs."""
