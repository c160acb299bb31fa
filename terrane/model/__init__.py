"""Vocabulary of the graph."""
