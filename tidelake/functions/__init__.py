"""Expressions: accumulators, filter documents, time arithmetic."""
