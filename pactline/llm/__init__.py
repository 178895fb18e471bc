"""Operators for preparing training corpora: cleaning, near duplicates, leaks, mixing."""
