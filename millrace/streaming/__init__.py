"""Structured Streaming runs of the table operators."""
