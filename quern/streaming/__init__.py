"""Structured Streaming forms of the evaluation."""
