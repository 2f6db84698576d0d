"""Structured Streaming twins of the order-dependent operators."""
