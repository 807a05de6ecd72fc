"""Batch retrieval and evaluation of generated SQL, as DataFrame operators."""
