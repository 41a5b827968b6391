"""Relational operators: merges, audits, aggregates, and the extraction of structure from text."""
