"""Structured Streaming forms of the order-aware operators."""
