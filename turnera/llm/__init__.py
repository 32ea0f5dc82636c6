"""Operators for training data: one module each, queries and their SQL in ``queries``."""
