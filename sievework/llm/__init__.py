"""Operators for the texts of training data."""
