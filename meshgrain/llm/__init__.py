"""Operators for preparing training text: near-duplicates, substring dedup, scans, scoring and mixing."""
