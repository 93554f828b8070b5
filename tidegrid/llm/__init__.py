"""Operators for preparing text corpora at scale, and their queries."""
