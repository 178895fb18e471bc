"""Datasets, contract documents and the append-only control tables."""
