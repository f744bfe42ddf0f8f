"""Operators for preparing training data: scans, duplicates, decontamination, mixing, scores."""
