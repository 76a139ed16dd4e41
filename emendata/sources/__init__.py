"""Readers of correction corpora: lines of text to pair tables; each takes a DataFrame of lines or a path."""
