"""Readers: driver tables, derived inputs, history and persona files."""
