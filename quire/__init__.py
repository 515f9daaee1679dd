"""Corpus-scale document analytics on Spark."""
