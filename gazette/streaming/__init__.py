"""Structured Streaming form of a run."""
