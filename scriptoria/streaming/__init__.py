"""Structured Streaming forms of the ledgers."""
