"""Composed jobs: registered queries, the digest run and their SQL oracles."""
