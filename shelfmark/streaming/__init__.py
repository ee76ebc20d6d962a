"""Structured Streaming over the same relations."""
