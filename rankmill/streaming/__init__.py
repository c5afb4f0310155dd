"""Structured Streaming jobs: the continuous twins of the batch operators."""
