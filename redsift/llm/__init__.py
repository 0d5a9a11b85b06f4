"""Operators for training data: splits, term counts, leaks between sets, cut text, packing and subjects."""
