"""Structured Streaming into datasets."""
