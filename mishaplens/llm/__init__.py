"""Operators on texts, terms, sequences, names and vectors for corpus preparation."""
